"""Query planning: from the parsed expression to a DataFrame."""
