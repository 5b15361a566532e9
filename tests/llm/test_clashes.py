"""Every operator and stage on a table whose further columns bear the names that they use or return."""

import random

import corpus_pipeline as C
import pytest

from loquat.llm import alignment, ann, decontaminate, fill_in_middle, jaccard_join, licenses, line_dedup, packing, quality, secrets, substring_dedup, url_filter, warc
from loquat.llm.common import Stage

NAMES = """_row _doc _text _kept _score _digest _gone _gone_digest _url _block _words a b at block bytes cls code component component_id count ctx
digest doc doc_tokens form h hub id ids ids_crc32 item_id key kept label lcs leaf length lines n n_bytes n_dropped n_lines n_shingles
notices ordinal own_id path piece place query_id rank removed rep rule score sequence_id shard size span spans start succ tok url v vector verdict weight words x""".split()


def wide(spark, rows, schema):
    """Rows with an int column for each name that they haven't, and one with a dot and a blank."""
    own = {c.split()[0] for c in schema.split(", ")}
    more = [c for c in NAMES if c not in own] + ["a.b c"]
    return spark.createDataFrame([(*r, *range(len(more))) for r in rows], schema + "".join(f", `{c}` int" for c in more))


def documents(spark, ids=lambda k: k, kind="long"):
    rng = random.Random(2)
    words = [a + b for a in "ba ke lo mu ni ra so".split() for b in "ti vu xa zo".split()]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)) for _ in range(30)]
    texts += [texts[0], texts[1] + " ti", None, "", "so. " * 30_000]
    rows = [(ids(k), t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return wide(spark, rows, f"doc_id {kind}, text string, lang string, source string, n_chars long")


def benchmark(spark):
    return wide(spark, [(k, f"an item {k} that no document has, with words of its own like these") for k in range(5)], "item_id long, text string")


def labels(spark, ids=lambda k: k, kind="long"):
    return wide(spark, [(ids(k), k % 2, 0) for k in range(20)], f"doc_id {kind}, quality int, toxic int")


def pages(spark):
    return wide(spark, [(k, f"http://h{k % 3}.com/en/{k}", "p" * (k * 30)) for k in range(12)], "page_id long, url string, html string")


def warc_records(spark):
    stage = Stage(spark, "clash")
    warc.write_archive(pages(spark), stage.path("a"), stage, "page_id", "url", "html")
    return warc.read_archive(spark, stage.path("a"), stage)


def vectors(spark):
    rng = random.Random(4)
    return wide(spark, [(k, [rng.random() for _ in range(8)]) for k in range(40)], "vec_id long, embedding array<double>")


OPERATORS = {
    "ann": (lambda s: ann.search(vectors(s), vectors(s).filter("vec_id < 4"), "vec_id", "embedding"), 40),
    "packing": (lambda s: packing.pack_documents(documents(s)).select("doc_id").distinct(), 35),
    "line_dedup": (lambda s: line_dedup.drop_templates(documents(s)), 35),
    "quality": (lambda s: quality.score_documents(documents(s), labels(s)), 35),
    "substring_dedup": (lambda s: substring_dedup.remove_repeats(documents(s)), 35),
    "licenses": (lambda s: licenses.scan(documents(s), licenses.known_digests(s)), 35),
    "url_filter": (lambda s: url_filter.judge_urls(pages(s), s.createDataFrame(url_filter.RULES, "rule string, verdict string")), 12),
    "jaccard_join": (lambda s: jaccard_join.link_documents(documents(s)), 35),
    "warc": (warc_records, 12),
    "decontaminate": (lambda s: decontaminate.find_leaks(documents(s), benchmark(s)), 0),
    "fill_in_middle": (lambda s: fill_in_middle.fill_in_middle(documents(s)), 35),
    "secrets": (lambda s: secrets.scan_secrets(documents(s)), 35),
    "alignment": (lambda s: alignment.align_tokenizers(documents(s))[0], 35),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    run, rows = OPERATORS[name]
    out = run(spark)
    assert len(out.collect()) == rows and len(set(out.columns)) == len(out.columns)


IDS = {"numbers": (lambda k: k, "long"), "texts": (lambda k: f"d{k}", "string"), "repeated": (lambda k: None if k % 3 == 0 else k // 4, "long")}


@pytest.mark.parametrize("ids", IDS)
def test_stages(spark, tmp_path, ids):
    folder = f"file://{tmp_path}"
    docs = documents(spark, *IDS[ids])
    labels(spark, *IDS[ids]).write.parquet(f"{folder}/labels.parquet")
    benchmark(spark).write.parquet(f"{folder}/benchmark.parquet")
    kept = {"line_dedup": 35, "ngram_jaccard_join": 33, "benchmark_decontamination": 35}
    for name, step in C.STAGES:
        out = step(spark, docs, folder)
        if name == "packing":
            assert out.count() >= 35
            continue
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        assert len(rows) == kept.get(name, len(rows)), name
        before = {str(r) for r in docs.collect()}
        assert name == "line_dedup" or all(str(r) in before for r in rows)


@pytest.mark.parametrize("ids", IDS)
def test_ids_of_any_kind(spark, ids):
    docs = documents(spark, *IDS[ids])
    assert quality.score_documents(docs, labels(spark, *IDS[ids])).count() == 35
    linked = jaccard_join.link_documents(docs).collect()
    assert len(linked) == 35
    if ids == "texts":
        of = {r.doc_id: r.component_id for r in linked}
        assert of["d30"] == of["d0"] == "d0" and of["d31"] == of["d1"] == "d1" and of["d32"] == "d32"
    assert substring_dedup.remove_repeats(docs).count() == 35
    assert len(decontaminate.find_leaks(docs, benchmark(spark)).collect()) == 0


def test_equal_rows_and_null_ids_leave_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (5, text + " x", "en", "s", 2), (5, "other " * 9, "en", "s", 3), (5, "other " * 9, "en", "s", 3), (7, None, "en", "s", 0), (8, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.ngram_jaccard_join(spark, docs, "").collect()
    assert sorted((r.doc_id, r.n_chars) for r in kept) == [(5, 2), (5, 3), (7, 0), (8, 0)]
