import random

import pytest

from gridloom.llm.mojibake import SAMPLE_DOCUMENTS, Classifier, _inspect_many, chains_of, count_on, decide, garble, garbled_documents, hash_bound, restore, script_of, train_on

WORDS = {
    "western": "für Straße größer Mädchen café déjà forêt élève l’été façade señor corazón mañana não coração irmão över åka från the town’s market and house wheat".split(),
    "polish": "żółty święto źródło łódź dzień książka między węgiel późno ćma kościół ogłosił młyn rząd gęś".split(),
    "greek": "εκκλησία σχολείο γιατρός μικρό πόλη δήλωσε επιστολή φωτιά κάθε προς μετά έλαβε".split(),
    "cyrillic": "каждый честный ярмарка письмо мельница вдова после нашему дорога склад собрание рынок".split(),
}


def page(rng, script, lines=12):
    made = []
    for _ in range(lines):
        words = [rng.choice(WORDS[script]) for _ in range(7)]
        line = " ".join(words)
        line = line.upper() if rng.random() < 0.1 else line[0].upper() + line[1:] + "."
        made.append(rng.choice([line, line, f"«{line}» ½ £ 3", f"├── {words[0].title()} ──┤", "|| ¬¬ ^^"]) if rng.random() < 0.4 else line)
    return "\n".join(made)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return train_on([page(rng, s) for s in WORDS for _ in range(150)])


def test_chains_invert():
    for script, words in WORDS.items():
        line = " ".join(words)
        for chain in chains_of(script):
            made = garble(line, chain)
            if made is not None and "�" not in made:
                assert restore(made, chain) == line, chain
        assert script_of(line) == script
    assert restore("plain é", (("utf-8", "cp1252"),)) is None


def test_the_sample_is_never_empty():
    assert hash_bound(0) == hash_bound(SAMPLE_DOCUMENTS) == 2**63 - 1
    for n in (10**6, 6 * 10**9 + 1, 2 * 10**10, 10**12, 10**15):
        share = (hash_bound(n) + 2**63) / 2**64
        assert share * n == pytest.approx(SAMPLE_DOCUMENTS, rel=1e-6)


def test_counting_as_tasks_gives_the_same_model(spark, model):
    rng = random.Random(1)
    other = train_on([page(rng, s) for s in WORDS for _ in range(150)], count_on(spark))
    assert (other.weights == model.weights).all() and (other.letters == model.letters).all()


def test_held_out_pages(model):
    rng = random.Random(2)
    clean = [page(rng, s) for s in WORDS for _ in range(60)]
    assert len(list(_inspect_many(model, clean))) <= 2
    found = restored = total = 0
    usual = [(s, c) for s in WORDS for c in chains_of(s) if c[0][0] == "utf-8" or c in ((("cp1250", "cp1252"),), (("cp1251", "cp1252"),), (("koi8-r", "cp1251"),), (("iso8859-7", "cp1252"),), (("cp1252", "cp850"),))]
    for script, chain in usual:
        text = page(rng, script)
        lines = text.split("\n")
        made = [garble(x, chain) for x in lines]
        if any(m is None for m in made):
            continue
        total += 1
        hit = list(_inspect_many(model, ["\n".join(made)]))
        found += bool(hit)
        restored += bool(hit) and hit[0][1][1] == text
    assert total > 30 and found / total > 0.95 and restored / total > 0.8


def test_single_lines_and_edges(model, spark):
    rng = random.Random(3)
    base = page(rng, "western").split("\n")
    bad = [garble(x, (("utf-8", "latin-1"),)) if i == 4 else x for i, x in enumerate(base[:4] + ["für die Straße vor dem café"] + base[4:])]
    rows = [(1, "\r\n".join(bad)), (2, "\n".join(base)), (3, None), (4, ""), (5, "ascii only"), (6, "the town�s market"), (None, garble("é" * 5000 + " façade", (("utf-8", "cp1252"),))), (1, "\r\n".join(bad))]
    rows += [(100 + k, page(rng, s)) for k, s in enumerate(list(WORDS) * 40)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, chain string, log_odds double")
    out = garbled_documents(docs).collect()
    assert sorted(str(r["doc_id"]) for r in out if r["doc_id"] is None or r["doc_id"] < 100) == ["1", "1", "6", "None"] and len(out) <= 6
    one = next(r for r in out if r["doc_id"] == 1)
    assert one["restored"].split("\r\n")[4] == "für die Straße vor dem café" and one["restored_lines"] == 1
    assert garbled_documents(docs.limit(0)).count() == 0
    assert isinstance(model, Classifier)


QUOTED = "“The town’s market opened” — near the façade. “No cargo” was lost — the town’s school received “every letter” £ 3".split()


@pytest.fixture(scope="module")
def quoted():
    """A model of English pages, and such pages: few words have letters beyond ASCII, most signs are marks."""
    rng = random.Random(5)
    made = lambda: "\n".join(" ".join(rng.choice(QUOTED) for _ in range(8)) for _ in range(12))
    return train_on([made() for _ in range(300)] + [page(rng, s) for s in WORDS for _ in range(80)]), [made() for _ in range(40)]


def test_few_words_decide(quoted):
    model, clean = quoted
    assert not list(_inspect_many(model, clean))
    chain = (("cp1252", "cp850"),)
    lines = ["The town’s market opened", "near the façade. “No cargo”", "plain words between", "THE TOWN’S SCHOOL"]
    hit = list(_inspect_many(model, ["\n".join(garble(x, chain) for x in lines)]))
    assert hit and hit[0][1][0] == "cp1252>cp850"


def test_letters_for_letters_and_every_line_of_a_found_page(model, quoted):
    rng = random.Random(6)
    chain = (("cp1252", "cp1250"),)
    text = "\n".join("não coração à forêt irmão mañana señor år på".split()[i % 9] + " the wheat l’été não irmão" for i in range(12))
    hit = list(_inspect_many(model, ["\n".join(garble(x, chain) for x in text.split("\n"))]))
    assert hit and hit[0][1][1] == text
    chain = (("cp1252", "mac_roman"),)
    lines = ["near the façade. “No cargo”", "the town’s school", "The town’s façade — opened", "the façade of the town’s market", "“every letter” near the façade"]
    hit = list(_inspect_many(quoted[0], ["\n".join(garble(x, chain) for x in lines)]))
    assert hit and hit[0][1][1].split("\n") == lines and rng


def test_two_single_byte_chains_in_a_page(model):
    rng = random.Random(7)
    text = page(rng, "western", 16).split("\n")
    text = [x for x in text if not x.startswith(("├", "|", "«"))]
    made = [garble(x, (("cp1252", "cp850" if i % 2 else "mac_roman"),)) for i, x in enumerate(text)]
    hit = list(_inspect_many(model, ["\n".join(made)]))
    wrong = [x for x, y in zip(hit[0][1][1].split("\n"), text, strict=True) if x != y]
    assert len(wrong) <= 2


def test_repeated_chains_and_strictness(model):
    line = "für die Straße vor dem café"
    latin, windows = ("utf-8", "latin-1"), ("utf-8", "cp1252")
    for text, chain in ((line, (latin,) * 3), (line, (windows,) * 3), (" ".join(WORDS["cyrillic"]), (("utf-8", "cp1251"),) * 2)):
        hit = list(_inspect_many(model, [garble(text, chain)]))
        assert hit and hit[0][1][1] == text and hit[0][1][4] == 1, chain
        assert hit[0][1][0] == "+".join(f"{a}>{b}" for a, b in chain)
    line, chain = "HO\u0308GA\u030aS VA\u0308SHO\u0308GTE DET A\u030aR", (("utf-8", "mac_roman"),)  # the likeliest class doesn't invert, the next one does
    odd = [garble(line, chain)]
    odds, best, table = model.judge(odd)
    odds[0], best[0], table[0, model.classes.index(("western", chain))] = 40.0, model.classes.index(("western", (latin, latin))), 40.0
    assert decide(model, odd, [0], odd, odds, best, table)[:2] == ("utf-8>mac_roman", line)
    assert restore("aü", (("cp1252", "cp850"),)) is None  # byte 81 is no character of cp1252


def test_the_sample_is_no_prefix(monkeypatch):
    seen = []
    monkeypatch.setattr("gridloom.llm.mojibake.SAMPLE_LINES", 50)
    monkeypatch.setattr(Classifier, "train", classmethod(lambda cls, lines, count, train=Classifier.train: seen.append(lines) or train(lines)))
    train_on([f"{c}{k} café" for c in "abcdefghijklmnopqrstuvwxyz" for k in range(20)])
    assert len(seen[0]["western"]) == 50 and len({x[0] for x in seen[0]["western"]}) > 15


def test_a_single_odd_line_is_enough_but_capitals_are_no_evidence():
    """Ä and Ü begin few words, which a chain could turn into words with é and ö; that alone is no case."""
    rng = random.Random(1)
    rare = ["Die Übung der Ärzte", "Über die Ärzte"]
    model = train_on([page(rng, s) + (f"\n{rng.choice(rare)} {k}" if k % 20 == 0 else "") for s in WORDS for k in range(150)])
    clean = "\n".join(["Straße und größer, für Mädchen"] * 3 + ["the house and market"])
    assert list(_inspect_many(model, [clean + "\nJeder Ärzte begann. Über Dorf"])) == []
    one = garble("la façade déjà élève forêt", (("cp1252", "cp850"),))
    found = list(_inspect_many(model, [clean + "\n" + one]))
    assert found and found[0][1][1].endswith("la façade déjà élève forêt")
