"""The pipeline against plain Python over the same documents."""

import hashlib

import public_tokenizers as P
import pyarrow as pa
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from civicframe.llm import byte_bpe, ftrl_quality, html_blocks, line_crf, qgram_decontam, simhash_gray, warc_derive
from civicframe.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def slow_components(codes):
    """Smallest place reachable from each place over codes within two bits."""
    root = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(codes):
            for j in range(i):
                if (a ^ codes[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def slow_pipeline(spark):
    labels, bench = table(spark, FOLDER, "labels"), table(spark, FOLDER, "benchmark")
    docs = table(spark, FOLDER, "documents")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())

    def frame():
        return spark.createDataFrame(rows, "doc_id long, text string")

    field = line_crf.fit(frame(), labels)
    rows = [r for r in rows if line_crf.judge(r[1], field)[6]]
    model = ftrl_quality.fit(frame(), labels)
    rows = [r for r, s in zip(rows, model.score(pa.array([t for _, t in rows]))) if s >= 0.5]
    root = slow_components([int(c) for c in simhash_gray.fingerprints(pa.array([t for _, t in rows]))])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    passages = [qgram_decontam.normal(r["text"]) for r in bench.collect()]
    return [r for r in rows if not any(p in qgram_decontam.normal(r[1]) for p in passages)]


def test_stages_match_plain_code(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: enc.encode_ordinary(t) for i, t in slow_pipeline(spark)}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want) > 50
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and r["decoded_equal"] for r in got)


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0)], docs.schema)
    both = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, both, FOLDER)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, both.limit(0), FOLDER).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, both, FOLDER).count() == both.count()


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "y"), (3, "A b c D", "z"), (None, "", "n"), (9, None, "m"), (1, "other words here now", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __spare string")
    kept = simhash_gray.keep(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 3, 9] and kept[0].__fields__ == docs.columns


def test_entry_registers_all_operators():
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5



def test_large_ids_and_nulls_stay_as_they_are(spark):
    big = 2**53 + 1
    text = "several plain words that say something about a thing. " * 12
    docs = spark.createDataFrame([(big, text, big), (None, text, None), (3, "short", 7)], "doc_id long, text string, other long")
    field = line_crf.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    out = line_crf.apply(docs.coalesce(1), field).collect()
    assert [r["doc_id"] for r in out] == [big, None, 3]
    kept = [tuple(r) for r in line_crf.keep(docs.coalesce(1), field).collect()]
    assert all(r in [tuple(x) for x in docs.collect()] for r in kept)
    pages = spark.createDataFrame([(big, "http://a", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    assert [tuple(r)[:2] for r in html_blocks.apply(pages).collect()] == [(big, "http://a"), (None, None)]
    assert [r["page_id"] for r in warc_derive.apply(warc_derive.responses(pages)).collect()] == [big, None]
