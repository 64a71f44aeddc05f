"""Queries on texts; SQL twins only where SQL can follow."""

from __future__ import annotations

from formquarry.llm import leakage, mixture, spans
from formquarry.session import read_table

#: Of the public tokenizers the byte-level one for many languages.
_TOKENIZER = f"{mixture.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def p6_found(spark, sf):
    return leakage.leaked_pairs(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p6_phrases(spark, sf):
    """The leaked runs themselves: where in the item they begin and how many words they have."""
    found = leakage.phrase_matches(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))
    return found.select("doc_id", "item_id", "shift", "first_word", "words")


def p6_proximity(spark, sf):
    return leakage.proximity_matches(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def _mixed(spark, sf):
    sized = mixture.sized_documents(read_table(spark, sf, "documents"), _TOKENIZER)
    sources = mixture.plan(sized, read_table(spark, sf, "mix_targets"))
    return mixture.mixture(sized, sources), sources


def p7_mixture(spark, sf):
    return _mixed(spark, sf)[0]


def p7_report(spark, sf):
    return mixture.report(*_mixed(spark, sf))


def p8_found(spark, sf):
    return spans.shared_spans(read_table(spark, sf, "documents"))


def p8_amounts(spark, sf):
    return spans.shared_amounts(read_table(spark, sf, "documents"), p8_found(spark, sf))


QUERIES = {f.__name__: f for f in (p6_found, p6_phrases, p6_proximity, p7_mixture, p7_report, p8_found, p8_amounts)}

_SPANS = """
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE len(text) >= 100),
windows AS (SELECT doc_id, s, substr(text, s + 1, 100) AS w FROM (SELECT doc_id, text, unnest(range(len(text) - 99)) AS s FROM docs)),
shared AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) != max(doc_id)),
hits AS (SELECT DISTINCT doc_id, s FROM windows SEMI JOIN shared USING (w)),
opened AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS opens FROM hits),
numbered AS (SELECT doc_id, s, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM opened),
spans AS (SELECT doc_id, min(s) AS span_start, max(s) + 100 - min(s) AS span_chars FROM numbered GROUP BY doc_id, span)"""

#: NFKC and tokens are beyond SQL, so the queries of problems 6 and 7 have no twin; their tests compare with brute force.
ORACLES: dict[str, str] = {
    "p8_found": _SPANS + " SELECT * FROM spans",
    "p8_amounts": _SPANS
    + """, totals AS (SELECT doc_id, sum(span_chars)::BIGINT AS n FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(len(text), 0) AS chars, coalesce(n, 0) AS shared_chars, coalesce(coalesce(n, 0) / nullif(len(text), 0)::DOUBLE, 0.0) AS shared_share FROM documents LEFT JOIN totals USING (doc_id)""",
}
