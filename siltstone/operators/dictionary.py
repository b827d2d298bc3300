"""Which of many phrases stand in which texts: one automaton, one pass over each text.

The phrases are joined into an Aho-Corasick automaton, so a text costs its
length and its hits, however many phrases there are. Phrases travel to the
executors in shards of bounded size; more of them than one shard holds are
matched in several passes over the texts. Each worker makes the automaton of a
shard once.

Defined cases: null or empty phrases match nothing; null texts count as empty;
equal phrases are one; phrases match as they stand, overlapping ones each, with
`apart` only those places of a phrase that begin beyond the end of the last counted;
repeated keys give a row each; very long texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import spread

#: Bytes of phrases in one automaton, about.
SHARD_BYTES = 16 << 20
#: The automaton that this worker made last, by its shard.
_made: dict[str, object] = {}


def _automaton(shard: str, phrases: list[str]):
    if shard not in _made:
        import ahocorasick

        _made.clear()
        out = ahocorasick.Automaton()
        for p in phrases:
            out.add_word(p, p)
        out.make_automaton()
        _made[shard] = out
    return _made[shard]


def found(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "phrase", shard_bytes: int = SHARD_BYTES, apart: bool = False) -> DataFrame:
    """(key, phrase, n): how often each phrase stands in each text that holds it."""
    wanted = phrases.select(F.col(phrase).alias("p")).where(F.length("p") > 0).distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("p") + 16), F.lit(0))).first()[0]
    shards, spark, out = max(1, -(-size // shard_bytes)), texts.sparkSession, None
    kind = texts.schema[key].dataType.simpleString()
    source = spread(texts.select(F.col(key).alias("k"), F.col(text).alias("t")))
    for shard in range(shards):
        own = wanted.where(F.pmod(F.xxhash64("p"), F.lit(shards)) == shard) if shards > 1 else wanted
        sent = spark.sparkContext.broadcast([r.p for r in own.collect()])  # a shard's bytes at most

        def batches(it: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            words = sent.value
            automaton = _automaton(name, words) if words else None
            for b in it:
                at, hits, counts = [], [], []
                for i, t in enumerate(b.column(1)):
                    seen: dict[str, int] = {}
                    ends: dict[str, int] = {}
                    for end, p in automaton.iter(t.as_py() or "") if automaton else ():
                        if not apart or end - len(p) >= ends.get(p, -1):
                            seen[p], ends[p] = seen.get(p, 0) + 1, end
                    at += [i] * len(seen)
                    hits += seen
                    counts += seen.values()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string()), pa.array(counts, pa.int64())], names=["k", "p", "n"])

        near = source.mapInArrow(batches, f"k {kind}, p string, n long")
        out = near if out is None else out.unionByName(near)
    return out.select(F.col("k").alias(key), F.col("p").alias(phrase), "n")


def missing(phrases: DataFrame, texts: DataFrame, phrase: str = "phrase", text: str = "text") -> DataFrame:
    """The rows of phrases whose phrase no text holds; null and empty phrases are held by any."""
    hits = found(texts.withColumn("k_", F.lit(0)), phrases, "k_", text, phrase).select(phrase).distinct()
    return phrases.where(F.length(phrase) > 0).join(hits, phrase, "left_anti")


def missing_links(pages: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """(page_id, entity) where a page names an entity between spaces without linking to it. pages: (page_id, html), links: (page_id, entity), entities: (entity)."""
    named = entities.select("entity", F.concat(F.lit(" "), "entity", F.lit(" ")).alias("phrase"))
    hits = found(pages, named, "page_id", "html").join(named, "phrase").select("page_id", "entity")
    return hits.join(links.select("page_id", "entity").distinct(), ["page_id", "entity"], "left_anti")
