"""Extra columns with dotted or internal-looking names pass through the row-wise operators."""

import public_tokenizers

from corpusrules.llm import bpe, decontaminate, html_text, ngram_join, secrets_scan, substring_dedup
from corpusrules.llm.catalog import RANKS


def test_dotted_and_internal_names(spark):
    docs = spark.createDataFrame(
        [(1, "token = 'Ab3dEf6hIj9kLmNo' and some words", 5, 6), (2, None, 7, 8), (2, "x", 9, 10)],
        "doc_id long, text string, `a.b` int, `__n` int",
    )
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://x/", "<p>hi</p>", 3)], "page_id long, url string, html string, `a.b` int")
    path = public_tokenizers.path(RANKS)
    runs = [
        secrets_scan.digests(docs),
        substring_dedup.mark(docs),
        decontaminate.find_items(docs, bench),
        bpe.round_trip(docs, path, public_tokenizers.PATTERN),
        html_text.extract(pages),
        ngram_join.keep_first(docs),
    ]
    for out in runs:
        assert "a.b" in out.columns
        assert out.count() >= 1
    kept = ngram_join.keep_first(docs).collect()
    assert sorted((r.doc_id, r["__n"]) for r in kept) == [(1, 6), (2, 10)]
