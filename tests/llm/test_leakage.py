import random

import pytest
from pyspark.sql import functions as F

from stratalith.llm import leakage as lk

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(RNG.randrange(2, 11))) for _ in range(900)]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def brute(docs, items):
    return {(d, i) for d, t in docs if t for i, p in items if p and lk.has_stretch(lk.words(p), lk.words(t), 20, 1 / 6)}


def disguise(t, rng):
    how = rng.randrange(6)
    if how == 0:
        return t.upper().replace(" ", "\n  ", 3)
    if how == 1:
        return t.replace("é", "&eacute;").replace("ñ", "n")
    if how == 2:
        return " ".join(f"<b>{w}</b>" if rng.random() < 0.3 else w for w in t.split())
    if how == 3:
        return "".join(c + ("­" if rng.random() < 0.1 else "") for c in t)
    if how == 4:
        return t.replace(" ", ", ", 5) + "!"
    return " ".join(w[:2] + "-\n" + w[2:] if len(w) > 6 and rng.random() < 0.2 else w for w in t.split())


def test_planted_cases(spark):
    rng = random.Random(9)
    items = [(f"q{k}", text(rng.randrange(22, 60), rng)) for k in range(40)]
    docs, want = [], set()
    for d in range(400):
        body = [text(rng.randrange(5, 60), rng)]
        if d % 2 == 0:
            q, p = rng.choice(items)
            ws = p.split()
            n = rng.choice((12, 16, 20, 24, len(ws)))
            at = rng.randrange(0, max(1, len(ws) - n))
            part = ws[at : at + n]
            edits = rng.randrange(0, max(1, len(part) // 6 + 2))
            for e in sorted(rng.sample(range(len(part)), edits), reverse=True):
                kind = rng.randrange(3)
                if kind == 0:
                    part[e] = rng.choice(VOCAB)
                elif kind == 1:
                    del part[e]
                else:
                    part.insert(e, rng.choice(VOCAB))
            body.insert(rng.randrange(2), disguise(" ".join(part), rng))
        docs.append((d, "\n\n".join([*body, text(rng.randrange(0, 40), rng)])))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, item_id string, i string").repartition(3)
    q = spark.createDataFrame(items, "id string, passage string")
    got = {(r.doc_id, r.item_id) for r in lk.disclosures(df, q, "doc_id", "text", "id", "passage").collect()}
    want = brute(docs, items)
    assert len(want) > 60 and got == want


def test_limits_of_the_definition():
    item = [f"w{i}".encode() for i in range(60)]
    has = lambda doc: lk.has_stretch(item, doc, 20, 1 / 6)
    assert has(item[5:25]) and not has(item[5:24])
    three = item[5:25]
    three[3], three[9], three[15] = b"x", b"y", b"z"
    four = list(three)
    four[6] = b"v"
    assert has(three) and not has(four)
    assert has(item[0:10] + item[11:21]) and has(item[0:10] + [b"n"] + item[10:20]) and not has(item[0:20][::-1])
    assert has([item[0] + item[1], *item[2:20]]) and has([b"w", b"0", *item[1:20]])


def test_dirty_rows(spark):
    p = text(30)
    items = spark.createDataFrame([("a", p), ("a", p), ("n", None), ("s", "too short"), (None, p)], "id string, passage string")
    docs = spark.createDataFrame([(1, p), (1, p), (2, None), (3, ""), (4, "x " * 200_000 + p), (None, p), (5, "…")], "doc_id long, text string")
    got = sorted(map(tuple, lk.disclosures(docs, items, "doc_id", "text", "id", "passage").collect()))
    assert got == [(1, "a"), (4, "a")]
    assert lk.disclosures(docs.limit(0), items, "doc_id", "text", "id", "passage").count() == 0
    assert lk.disclosures(docs, items.limit(0), "doc_id", "text", "id", "passage").count() == 0
    book = text(12_000, random.Random(3))
    part = " ".join(book.split()[8_000:8_030])
    found = lk.disclosures(spark.createDataFrame([(1, "x " + part + " y"), (2, book)], "doc_id long, text string"), spark.createDataFrame([("b", book)], "id string, passage string"), "doc_id", "text", "id", "passage")
    assert sorted(r.doc_id for r in found.collect()) == [1, 2]


def test_items_beyond_one_part(spark):
    rng = random.Random(77)
    items = [(f"m{k}", text(24, rng)) for k in range(60)]
    docs = spark.createDataFrame([(k, f"{text(9, rng)} {p}") for k, (_, p) in enumerate(items)] + [(99, text(50, rng))], "doc_id long, text string")
    q = spark.createDataFrame(items, "id string, passage string")
    found = {n: sorted(map(tuple, lk.disclosures(docs, q, "doc_id", "text", "id", "passage", part=n).collect())) for n in (7, 60, 3_000)}
    assert found[7] == found[60] == found[3_000] == sorted((k, f"m{k}") for k in range(60))


@pytest.mark.parametrize("n,at", [(24, (5, 9, 13, 17)), (30, (10, 12, 14, 16, 18)), (36, (10, 13, 16, 19, 22, 25))])
def test_clustered_edits_in_longer_stretches(spark, n, at):
    # No shorter stretch holds: every 20 words have more than 3 edits, and the edited words are the longest.
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    item = [word(12 if k in at else 8) for k in range(n)]
    doc = [word(12) if k in at else w for k, w in enumerate(item)]
    over = [word(12) if k in (*at, n - 2) else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(over))], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(item))], "id string, passage string")
    assert [tuple(r) for r in lk.disclosures(docs, items, "doc_id", "text", "id", "passage").collect()] == [(1, "a")]


def test_item_whose_edits_leave_no_q_gram(spark):
    item = [f"{c}{k % 3}" if k % 2 else c for k, c in enumerate("abcdefghijklmnopqrstuvwx")]
    doc = ["zz" if k in (4, 9, 14) else w for k, w in enumerate(item[:20])]
    docs = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(doc[:19]))], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(item))], "id string, passage string")
    assert [tuple(r) for r in lk.disclosures(docs, items, "doc_id", "text", "id", "passage").collect()] == [(1, "a")]


def by_edit_distance(item, doc, run=20, one_in=6):
    """Independent of has_stretch: edit distance from every first word, both ends held."""
    for a in range(len(item) - run + 1):
        row = [10**6] * (len(doc) + 1)  # edits up to item word i, doc words used
        for i in range(a, len(item)):
            new = [10**6] * (len(doc) + 1)
            for j in range(len(doc) + 1):
                if j and item[i] == doc[j - 1]:
                    held = 0 if i == a else row[j - 1]
                    if i - a + 1 >= run and held * one_in <= i - a + 1:
                        return True
                    new[j] = held
                if i > a:
                    new[j] = min(new[j], row[j] + 1, row[j - 1] + 1 if j else 10**6)
                new[j] = min(new[j], new[j - 1] + 1 if j else 10**6)
            row = new
    return False


def test_added_words_in_a_row(spark):
    item = text(38, random.Random(21)).split()
    aside = [text(n, random.Random(n)).split() for n in (4, 5, 6, 7)]
    bodies = [[*item[:19], *x, *item[19:]] for x in aside]
    enc = lambda ws: lk.words(" ".join(ws))
    assert [lk.has_stretch(enc(item), enc(b), 20, 1 / 6) for b in bodies] == [True, True, True, False]
    docs = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(bodies)], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(item))], "id string, passage string")
    assert sorted(r.doc_id for r in lk.disclosures(docs, items, "doc_id", "text", "id", "passage").collect()) == [0, 1, 2]


def test_copies_and_long_added_words(spark):
    rng = random.Random(5)
    p = text(36, rng).split()
    body = [w for k, w in enumerate(p) for w in ([w, "x" * 10] if k in (5, 10, 15, 20, 25, 30) else [w])]  # 60 letters more
    docs = [(k, " ".join(body)) for k in range(20)] + [(k, text(60, random.Random(k))) for k in range(20, 40)]
    items = spark.createDataFrame([("a", " ".join(p))], "id string, passage string")
    found = lk.disclosures(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), items, "doc_id", "text", "id", "passage")
    assert sorted(map(tuple, found.collect())) == [(k, "a") for k in range(20)]


def test_alignment_equals_edit_distance():
    rng, held = random.Random(31), 0
    for case in range(600):
        item = [f"w{rng.randrange(9) if rng.random() < 0.15 else 10 + k}x".encode() for k in range(rng.randrange(20, 46))]
        doc = list(item)
        for _ in range(rng.randrange(1, 6)):
            at, n = rng.randrange(len(doc)), rng.randrange(1, 7)
            how = rng.randrange(4)
            new = [f"w{rng.randrange(9)}x".encode() if rng.random() < 0.3 else f"z{rng.randrange(99)}x".encode() for _ in range(n)]
            if how == 0:
                doc[at : at + 1] = new[:1]
            elif how == 1:
                del doc[at : at + rng.choice((1, 1, 2))]
            else:
                doc[at:at] = new
            if len(doc) < 2:
                break
        want = by_edit_distance(item, doc)
        held += want
        assert lk.has_stretch(item, doc, 20, 1 / 6) == want, (case, item, doc)
    assert 100 < held < 500


def test_edits_right_after_the_first_word():
    item = [f"w{k}x".encode() for k in range(24)]
    doc = [b"y" if 1 <= k <= 4 else w for k, w in enumerate(item)]
    assert by_edit_distance(item, doc) and lk.has_stretch(item, doc, 20, 1 / 6)


def test_markup_of_any_length(spark):
    p = text(24, random.Random(41)).split()
    marks = [f'<a href="/{"longpath" * 90}">', f"<!-- {'remark <b>of</b> the editors ' * 90} -->", f"](/{'longtarget' * 60})", f'<p style="{"margin: 0; " * 300}"\n>']
    bodies = [" ".join(w + m * (k % 5 == 2) for k, w in enumerate(p)) for m in marks]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(p))], "id string, passage string")
    assert sorted(r.doc_id for r in lk.disclosures(docs, items, "doc_id", "text", "id", "passage").collect()) == [0, 1, 2, 3]
    for open_mark in ("<a ", "<!--", "](", "<!-- <a ]("):  # linear where nothing is closed
        assert lk.solid(open_mark * 200_000 + "end").endswith(b"end")
    assert lk.solid("a <!-- b --> c <!-- d") == b"acd"


#: (words of the stretch, words changed, their places, letters of a word)
PLANTED = [(24, 4, (9, 11, 13, 15), (2, 8)), (30, 5, (11, 13, 15, 17, 19), (2, 8)), (24, 4, None, (4, 8)), (24, 4, None, (1, 3)), (20, 3, None, (1, 3))]


@pytest.mark.parametrize("n,edits,places,letters", PLANTED)
def test_every_planted_stretch_is_found(spark, n, edits, places, letters):
    rng = random.Random(n * edits + letters[0])
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(*letters)))
    items, docs = [], []
    for k in range(120):
        item = [word() for _ in range(n)]
        doc = list(item)
        for at in places or rng.sample(range(1, n - 1), edits):
            doc[at] = word() + "x"
        assert by_edit_distance(item, doc)
        items.append((f"p{k}", " ".join(item)))
        docs.append((k, " ".join([word() for _ in range(15)] + doc + [word() for _ in range(15)])))
    found = lk.disclosures(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "id string, passage string"), "doc_id", "text", "id", "passage")
    assert {(k, f"p{k}") for k in range(120)} <= {tuple(r) for r in found.collect()}


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрстуфх", "αβγδζηθλμξπστφχψ", "אבגדהוזחטיכל", "가나다라마바사아자차", "łøđħŧæœəŋ"])
def test_passages_of_other_scripts(spark, letters):
    rng = random.Random(len(letters))
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
    ws = [word() for _ in range(26)]
    near = [word() if k in (8, 17) else w.upper() for k, w in enumerate(ws)]
    docs = [(1, f"{word()} — {', '.join(near)}; {word()}"), (2, " ".join(ws[:18])), (3, " ".join(word() for _ in range(40)))]
    found = lk.disclosures(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a", " ".join(ws))], "id string, passage string"), "doc_id", "text", "id", "passage")
    assert [tuple(r) for r in found.collect()] == [(1, "a")]


def test_letters_are_the_words_joined():
    for t in ("Ärger im Straßen-\nbau", "a\u2003b\u2028c\u0085d", "Łódź—Ωmega 5µm ﬁn", "soft\u00adhyphen zero\u200bwidth", "e\u0301te\u0301-\n nuit", "x<b>y</b> &amp; z", "١٢٣ четыре"):
        assert b"".join(lk.words(t)) == lk.solid(t), t
    assert lk.words("a\u2003b\u2028c\u0085d") == [b"a", b"b", b"c", b"d"]
