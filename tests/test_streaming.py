from loquat.operators import g2p as G
from loquat.plans import cases
from loquat.sources import lexicon as L
from loquat.streaming.speak import normalize_stream, phoneme_stream


def test_stream_is_normalised_and_spoken(spark, tmp_path):
    rows = spark.createDataFrame([(1, "túi 5kg"), (2, "market")], "id int, text string")
    rows.write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id int, text string").json(str(tmp_path / "in"))
    query = normalize_stream(stream()).writeStream.format("memory").queryName("spoken").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.normalized for r in spark.table("spoken").collect()} == {"túi năm ki lô gam", "market"}
    seen = {}
    small = spark.createDataFrame(cases.SMALL_LEXICON, L.SCHEMA)
    query = phoneme_stream(stream(), small, lambda batch, k: seen.update({r.id: r.phonemes for r in batch.collect()}), str(tmp_path / "check"))
    query.awaitTermination()
    assert seen[2] == "en-market" and seen[1].startswith("vi-túi")


def test_batches_of_a_stream_are_not_planned_anew(spark, tmp_path, monkeypatch):
    """Many small batches; and the same, each with its own plan, by a lexicon that is too large to be held."""
    rows = [(k, f"túi {k}kg") for k in range(6)]
    for row in rows:
        spark.createDataFrame([row], "id int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda n: spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", n).json(str(tmp_path / "in"))
    small = spark.createDataFrame(cases.SMALL_LEXICON, L.SCHEMA)
    one, other = {}, {}
    query = phoneme_stream(stream(1), small, lambda batch, k: one.update({r.id: r.phonemes for r in batch.collect()}), str(tmp_path / "one"))
    query.awaitTermination()
    times = [p["durationMs"]["triggerExecution"] / 1000 for p in query.recentProgress if p["numInputRows"]]
    print("seconds of each batch", times)
    assert len(one) == len(times) == 6
    monkeypatch.setattr(G, "HELD_WORDS", 3)
    phoneme_stream(stream(6), small, lambda batch, k: other.update({r.id: r.phonemes for r in batch.collect()}), str(tmp_path / "two")).awaitTermination()
    assert other == one
