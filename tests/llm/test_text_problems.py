import random
import unicodedata

import numpy as np
import pytest
from brute_text import leaked, spans, words
from hypothesis import given, settings
from hypothesis import strategies as st

from formquarry.llm import leakage, mixture
from formquarry.llm import spans as spanning
from formquarry.llm import text as texts

DOC = "doc_id long, text string, term string, pos int, anchor string, low string"


def docs(spark, items):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in items.items()], DOC)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id long, text string, doc_id string")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_words(text):
    assert texts.words(text) == words(text)


def test_words_of_narrow_and_wide_texts(spark):
    rng = random.Random(8)
    plain = [chr(c) for c in range(128)] + list("АБЯабяЁёйЙ«»–—")
    odd = list("™ЎўҐґЇїѕ\u00a0ﬁ²ÀßİІіґ№…\u0301\u00ad\u200b٣ⅷ")
    rows = ["".join(rng.choices(plain + (odd if i % 3 == 0 else []), k=rng.randint(0, 60))) for i in range(600)] + [None, "", "Ё_Ж-1"]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    found = {r.i: r.w for r in frame.select("i", texts.joined_words("text").alias("w")).collect()}
    assert found == {i: None if t is None else " ".join(words(t)) for i, t in enumerate(rows)}


def test_leaks_exactly(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    item = {i: " ".join(rng.choices(vocabulary, k=rng.randint(5, 40))) for i in range(25)}
    item |= {90: None, 91: "", 92: "one two", 93: "ab " * 40}
    doc = {}
    for d in range(60):
        source = (item[rng.randrange(25)] or "").split()
        k = rng.randrange(max(1, len(source) - 5))
        part = source[k : k + rng.randint(8, 16)]
        doc[d] = " ".join(rng.choices(vocabulary, k=10)) + "  " + "­, ".join(part).upper() + ". " + " ".join(rng.choices(vocabulary, k=6))
    doc |= {100: None, 101: "", 102: item[3], 103: item[3], 104: "Ab, " * 15, 105: "ﬁ " * 3}
    found = {tuple(r) for r in leakage.leaked_pairs(docs(spark, doc), items_of(spark, item)).collect()}
    assert found == leaked(doc, item) and (102, 3) in found and (104, 93) in found


def test_leak_empty_tables_and_repeats(spark):
    text = " ".join(f"a{i}" for i in range(12))
    assert leakage.leaked_pairs(docs(spark, {}), items_of(spark, {1: text})).count() == 0
    assert leakage.leaked_pairs(docs(spark, {1: text}), items_of(spark, {})).count() == 0
    twice = docs(spark, {1: text}).union(docs(spark, {1: text}))
    assert [tuple(r) for r in leakage.leaked_pairs(twice, items_of(spark, {1: text})).collect()] == [(1, 1)]
    assert leakage.leaked_pairs(docs(spark, {1: text[:-4]}), items_of(spark, {1: text})).count() == 0


def test_hot_item(spark):
    text = " ".join(f"a{i}" for i in range(20))
    found = leakage.phrase_matches(docs(spark, {i: f"{i} {text}" for i in range(200)}), items_of(spark, {1: text})).collect()
    assert len(found) == 200 and {(r.shift, r.first_word, r.words) for r in found} == {(1, 0, 20)}


def test_proximity_allows_edits(spark):
    text = [f"a{i}" for i in range(20)]
    edited = text[:5] + ["x"] + text[5:9] + text[10:]
    far = " filler ".join(" ".join(["f"] * 30) + " " + t for t in text)
    found = {tuple(r)[:2] for r in leakage.proximity_matches(docs(spark, {1: " ".join(edited), 2: far, 3: None}), items_of(spark, {7: " ".join(text)})).collect()}
    assert found == {(1, 7)}


def test_proximity_finds_every_edited_passage(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {i: rng.choices(vocabulary, k=60) for i in range(12)} | {90: rng.choices(vocabulary, k=9), 91: ["a"] * 20}
    passages, wanted = {1000: ["a"] * 6}, set()
    for d in range(120):
        i = rng.randrange(12)
        at = rng.randrange(49)
        part = texts[i][at : at + 12]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(part) + 1)
            part[k : k + rng.randint(0, 1)] = rng.choices(["x", "y"], k=rng.randint(0, 1))
        fill = lambda: [f"f{rng.randrange(9999)}" for _ in range(rng.randint(0, 40))]
        passages[d] = fill() + part + fill()
        wanted.add((d, i))
    passages[2002], passages[2003] = [w if k % 4 else "x" for k, w in enumerate(texts[1])], [w if k % 3 else "x" for k, w in enumerate(texts[1])]
    passages[2000] = [*texts[90][:4], "x", *texts[90][5:]]  # a short item with one word replaced
    # Rare words that one unrelated document has are no reason to pass a passage by.
    passages[2001] = rng.sample(texts[0], 60)
    found = {tuple(r)[:2] for r in leakage.proximity_matches(docs(spark, {d: " ".join(p) for d, p in passages.items()}), items_of(spark, {i: " ".join(t) for i, t in texts.items()})).collect()}
    assert wanted | {(2000, 90), (2002, 1)} <= found and found == near_pairs(passages, texts)
    assert not {(2001, 0), (2003, 1)} & found


def near_pairs(passages, texts, window=12, edits=3, gram=3):
    """The definition of proximity_matches by trial of every window and place; words as lists."""
    found = set()
    for d, words in passages.items():
        for i, text in texts.items():
            size = min(window, len(text))
            need = size - min(edits, (size - gram) // gram)
            for k in range(len(text) - gram + 1):
                for at in (p for p in range(len(words) - gram + 1) if words[p : p + gram] == text[k : k + gram]):
                    stands = lambda j: text[j] in words[max(j + at - k - edits, 0) : max(j + at - k + edits + 1, 0)]  # noqa: B023, E731
                    for start in range(max(k + gram - size, 0), min(k, len(text) - size) + 1):
                        if sum(map(stands, range(start, start + size))) >= need:
                            found.add((d, i))
    return found


def shared(spark, items, **more):
    return {tuple(r) for r in spanning.shared_spans(docs(spark, items), **more).collect()}


def test_spans_exactly(spark):
    rng = random.Random(3)
    letters = "абвгд xyz\n"
    passages = ["".join(rng.choices(letters, k=rng.randint(60, 260))) for _ in range(12)]
    items = {}
    for d in range(80):
        items[d] = "".join(p for _ in range(rng.randint(1, 4)) for p in (rng.choice(passages)[rng.randint(0, 40) :], "".join(rng.choices(letters, k=rng.randint(0, 90)))))
    items |= {200: None, 201: "", 202: "a" * 99, 203: "-" * 300, 204: "-" * 150 + "x" + "-" * 101, 205: "😀" * 120 + "b", 206: "c" + "😀" * 110, 207: items[0], 208: items[0], 209: passages[0][:50] * 9}
    assert shared(spark, items) == spans(items)
    assert shared(spark, items, length=30, gram=12) == spans(items, 30)


def test_spans_repeats_and_empty(spark):
    text = "".join(random.Random(1).choices("abcdef", k=150))
    assert shared(spark, {}) == set() and shared(spark, {1: text + "-" + text}) == set()
    twice = docs(spark, {1: text}).union(docs(spark, {1: text}))
    assert spanning.shared_spans(twice).count() == 0
    assert shared(spark, {1: text, 2: "q" + text}) == {(1, 0, 150), (2, 1, 150)}


def test_boilerplate_between_different_texts(spark):
    notice = "".join(random.Random(9).choices("abcdef", k=80))
    rng = random.Random(2)
    items = {i: "".join(rng.choices("ghijkl", k=60)) + notice + rng.choice(["AAAA" * 8, "BBBB" * 8, "C" + "D" * 30]) for i in range(150)}
    assert shared(spark, items) == spans(items)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spanning, "_CHUNK", 256)
    rng = random.Random(4)
    long = "".join(rng.choices("abcdef", k=3000))
    items = {1: long, 2: "zz" + long[100:1500] + "q" + long[1400:1800], 3: long[2900:] + "t"}
    found = {}
    for d, t in items.items():
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": [d], "text": [t]})
        found[d] = sum(sum(b.column(2).to_pylist()) for b in spanning.Winnower(100, 50).batches(iter([batch])))
        assert found[d] == max(0, len(codes) - 99)
    assert shared(spark, items) == spans(items)


def test_amounts(spark):
    text = "".join(random.Random(1).choices("abcdef", k=150))
    rows = docs(spark, {1: text, 2: text + text[:50], 3: None})
    assert sorted(tuple(r) for r in spanning.shared_amounts(rows, spanning.shared_spans(rows)).collect()) == [(1, 150, 150, 1.0), (2, 200, 150, 0.75), (3, 0, 0, 0.0)]


TARGETS = "source string, target_share double, max_repeats int"


def test_allocation():
    given_ = mixture.allocate({"a": 100, "b": 100, "c": 10}, {"a": (0.5, 9), "b": (0.25, 9), "c": (0.25, 2), "none": (0.0, 3)})
    assert given_["c"] == 20 and given_["none"] == 0 and sum(given_.values()) == pytest.approx(210) and given_["a"] == pytest.approx(2 * given_["b"])
    assert mixture.allocate({"a": 10}, {"a": (1.0, 0), "b": (1.0, 5)}) == {"a": 0.0, "b": 0.0}


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice([" Big", "big ", "mid", "SMALL", None, "other"])) for i in range(4000)] + [(9001, None, "big"), (9002, "", "mid")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("BIG", 0.2, 1), ("mid", 0.5, 3), (" small ", 0.2, 2), ("ghost", 0.2, 4), ("mid", None, None), (None, 0.4, 1)], TARGETS)
    sized = mixture.sized_documents(frame, f"{mixture.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    sources = mixture.plan(sized, targets)
    drawn = mixture.mixture(sized, sources)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, mixture.mixture(sized, sources).collect()))
    report = {r.source: r for r in mixture.report(drawn, sources).collect()}
    assert set(report) == {"big", "mid", "small", "ghost"} and report["ghost"].used == 0
    total = sum(r.available for r in report.values())
    assert sum(r.used for r in report.values()) == pytest.approx(total, rel=0.01)
    for row in sources.collect():
        assert report[row.source].used == pytest.approx(row.given, abs=120)
        assert report[row.source].most_copies <= row.repeats
    assert mixture.mixture(sized, sources, seed=1).exceptAll(drawn).count() > 0
    assert {r.source for r in drawn.select("source").distinct().collect()} <= {"big", "mid", "small"}


def test_weights_change_the_odds(spark):
    rows = [(i, "word " * 10, "a", float(1 + 9 * (i % 2))) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.9, 1)], TARGETS)
    sized = mixture.sized_documents(frame, f"{mixture.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "w")
    sources = mixture.plan(sized, targets).withColumn("given", mixture.F.col("given") * 0.1).withColumn("scale", mixture.F.col("scale") * 0.1)
    heavy = mixture.mixture(sized, sources).selectExpr("avg(doc_id % 2) AS share", "count(*) AS n").first()
    assert heavy.share > 0.8 and heavy.n == pytest.approx(200, abs=2)


def test_mixture_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    sized = mixture.sized_documents(frame, f"{mixture.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    sources = mixture.plan(sized, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert mixture.mixture(sized, sources).count() == 0
    assert mixture.report(mixture.mixture(sized, sources), sources).collect()[0].actual_share == 0.0


def test_categories_are_those_of_this_python():
    assert texts.words("a­b") == ["ab"] and unicodedata.category("­") == "Cf"
