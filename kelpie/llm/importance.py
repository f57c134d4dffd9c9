"""Importance resampling towards a target's distribution of hashed n-grams, over a dictionary of integer word ids.

1. Words. Tasks cut texts of about CHUNK_BYTES into lower-cased words, and emit for each such chunk its distinct words
   with their ids, its distinct n-grams as tuples of ids with their counts, and every document as counts of those tuples,
   all in rows of at most PIECE of each, so that no row, and no batch of rows, is large. A word's id is a
   seeded 64-bit hash; the dictionary (id, word) of the whole corpus, a group-by of the chunks' words, shows whether two
   words share one, and then all is done anew with another seed: the ids that are used are distinct.
2. Tuples. The chunks' counts are added by tuple, over documents and target. Each distinct tuple gets its words back
   from the dictionary (a join on id for each place), and their bytes are hashed to a bucket once. Counts join there: a
   bucket's gain is the logarithm of its share in the target over its share in the documents.
3. Documents. Gains go back to the chunks' tuples by a join and are gathered by chunk, which is bounded by its bytes;
   a document's weight is the floored mean over its n-grams.
4. Draw. Scores are weights plus Gumbel noise from a hash of doc_id, so the highest are a sample without replacement.
   Places come from range partitions and their counts, not from one window.

What moves is some rows for each distinct word of a chunk, a few hundredths of the words. Tables with a bound: the gains,
one for each bucket.

Defined results. Null and empty texts have no n-grams and weight 0. A null id is hashed as an empty one and stays null; ties of score and
id go to fewer n-grams. Repeated rows are documents of their own. An empty target leaves every gain to the documents'
counts alone; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows
from . import common, spans

BUCKETS = 10_000
GRAM = 1
LEAST_WORDS = 20
PERCENT = 10
DRAW_SEED = "2024"
CHUNK_BYTES = 16 << 20
#: A chunk's rows have so many of its words, tuples, documents and counts each; so many rows leave a task at a time. Row
#: groups are small, as a task reads the rows of one at once.
PIECE = 1 << 13
PIECES = 8
SMALL_GROUPS = {"parquet.block.size": str(16 << 20)}

#: ASCII digits and letters, the latter lower-cased, and all bytes of longer characters; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

CHUNK = (
    "chunk bigint, seq int, words array<string>, word_ids array<bigint>, grams array<array<bigint>>, gram_counts array<bigint>, "
    "doc_ids array<bigint>, n_words array<bigint>, n_features array<bigint>, kinds array<int>, bags binary"
)


def word_ids(words: list[bytes], seed: int) -> np.ndarray:
    buf, bounds = spans.joined(words)
    return spans.mix(spans.word_hashes(buf, bounds[:-1], bounds[1:]) + spans.mix(np.uint64([seed + 1]))).view(np.int64)


def _lists(flat, bounds: np.ndarray) -> pa.ListArray:
    """The lists between bounds."""
    return pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype("i4")), flat.slice(bounds[0], bounds[-1] - bounds[0]))


def packed_bags(at: np.ndarray, times: np.ndarray) -> bytes:
    """Differences of at, and times, byte by byte of all numbers, as most high bytes are zeros."""
    return np.stack([np.diff(at, prepend=0), times]).astype("<i4").view("u1").reshape(2, -1, 4).transpose(0, 2, 1).tobytes()


def unpacked_bags(bags: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, times = np.ascontiguousarray(np.frombuffer(bags, "u1").reshape(2, 4, -1).transpose(0, 2, 1)).view("<i4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), times


def chunk(doc_ids: pa.Array, ids: np.ndarray, n_words: np.ndarray, words: list[bytes], named: np.ndarray, gram: int) -> dict:
    """The columns of one chunk, from its documents' words as places in words, whose ids are named. A document's tuples
    are the next kinds[i] of at (which tuple) and times."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place, n = ids, len(ids)  # the number of the tuple, among those of its order, that begins at each word
    every, parts, docs_of, shift = [np.arange(len(words))[:, None]], [ids], [doc], len(words)
    for m in range(2, gram + 1):
        starts = np.flatnonzero(doc[: max(0, n - m + 1)] == doc[m - 1 :])
        found, first, inverse = np.unique(place[starts] * len(words) + ids[starts + m - 1], return_index=True, return_inverse=True)
        first = starts[first]
        every.append(np.concatenate([every[-1][place[first]], ids[first + m - 1][:, None]], axis=1))
        place = np.full(n, -1)
        place[starts] = inverse
        parts.append(inverse + shift)
        docs_of.append(doc[starts])
        shift += len(found)
    at, of = np.concatenate(parts), np.concatenate(docs_of)
    n_features = np.bincount(of, minlength=len(n_words))
    bag, times = np.unique(of * max(1, shift) + at, return_counts=True)
    of, at = bag // max(1, shift), bag % max(1, shift)
    sizes = np.concatenate([np.full(len(t), i + 1) for i, t in enumerate(every)])
    return {
        "words": pa.array(words, pa.binary()).cast(pa.string()), "word_ids": pa.array(named),
        "grams": _lists(pa.array(np.concatenate([named[t].ravel() for t in every])), np.cumsum([0, *sizes])),
        "gram_counts": pa.array(np.bincount(at, weights=times, minlength=shift).astype(np.int64)),
        "doc_ids": doc_ids, "n_words": pa.array(n_words), "n_features": pa.array(n_features.astype(np.int64)),
        "kinds": pa.array(np.bincount(of, minlength=len(n_words)).astype("i4")), "at": at, "times": times,
    }


def pieces(number: int, columns: dict, size: int):
    """Batches of CHUNK rows, each with the next `size` of every column, so that no row is large."""
    columns = dict(columns)
    at, times = columns.pop("at"), columns.pop("times")
    rows = -(-max(1, len(at), *map(len, columns.values())) // size)
    for a in range(0, rows, PIECES):
        seq = np.arange(a, min(rows, a + PIECES) + 1)
        lists = {k: _lists(v, np.minimum(seq * size, len(v))) for k, v in columns.items()}
        bags = [packed_bags(at[i * size : (i + 1) * size], times[i * size : (i + 1) * size]) for i in seq[:-1].tolist()]
        yield common.batch(chunk=np.full(len(bags), number), seq=seq[:-1].astype("i4"), **lists, bags=pa.array(bags, pa.binary()))


def chunks(docs: DataFrame, id_col: str | None, text_col: str, gram: int, seed: int) -> DataFrame:
    """CHUNK rows of all documents."""
    doc_id = F.col(id_col).cast("bigint") if id_col else F.lit(None).cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches):
        number = TaskContext.get().partitionId() << 32
        known, doc_ids, ids, n_words, held = {}, [], [], [], 0

        def out():
            words = list(known)
            named = word_ids(words, seed) if words else np.zeros(0, np.int64)
            return pieces(number, chunk(pa.concat_arrays(doc_ids), np.concatenate(ids).astype(np.int64), np.concatenate(n_words), words, named, gram), PIECE)

        # Slice by slice, as words that stand alone take some five times their text.
        for b in common.text_slices(batches, max(1, CHUNK_BYTES // 16)):
            raw = common.raw_texts(b)
            cut = [t.translate(FOLD).split() for t in raw]
            doc_ids.append(b.column("doc_id"))
            ids.append(np.array([known.setdefault(w, len(known)) for own in cut for w in own], np.int32))
            n_words.append(np.array([len(own) for own in cut], np.int64))
            held += sum(map(len, raw))
            del cut, raw
            if held >= CHUNK_BYTES:
                yield from out()
                number, known, doc_ids, ids, n_words, held = number + 1, {}, [], [], [], 0
        if doc_ids:
            yield from out()

    return rows.mapInArrow(work, CHUNK)


def dictionary(*of: DataFrame) -> DataFrame:
    """(id, word, other): word <> other where two words share an id."""
    rows = [c.select(F.explode(F.arrays_zip("word_ids", "words")).alias("w")).select("w.word_ids", "w.words") for c in of]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy(F.col("word_ids").alias("id")).agg(F.min("words").alias("word"), F.max("words").alias("other"))


def hashed(tuples: DataFrame, words: DataFrame, gram: int, buckets: int) -> DataFrame:
    """tuples (tuple, ...) with bucket: crc32 of the words, joined by one space, modulo buckets."""
    out = None
    for m in range(1, gram + 1):
        own = tuples.filter(F.size("tuple") == m)
        for i in range(m):
            own = own.join(words.select(F.col("id").alias(f"__id{i}"), F.col("word").alias(f"__w{i}")), F.col("tuple")[i] == F.col(f"__id{i}"))
        text = F.concat_ws(" ", *[f"__w{i}" for i in range(m)])
        own = own.select(*tuples.columns, (F.crc32(text.cast("binary")) % buckets).cast("int").alias("bucket"))
        out = own if out is None else out.unionByName(own)
    return out


def _counts(c: DataFrame, s: str, t: str) -> DataFrame:
    zipped = c.select(F.explode(F.arrays_zip("grams", "gram_counts")).alias("g"))
    n = {"n": F.col("g.gram_counts"), "0": F.lit(0).cast("bigint")}
    return zipped.select(F.col("g.grams").alias("tuple"), n[s].alias("s"), n[t].alias("t"))


def gains_of(grams: DataFrame, buckets: int) -> DataFrame:
    """grams (tuple, bucket, s, t) -> (bucket, gain), at most `buckets` rows."""
    per_bucket = grams.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = per_bucket.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda x: F.col(x).cast("double")
    share = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return per_bucket.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(share)).alias("gain"))  # one row of totals


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    for seed in count():
        own = common.written(chunks(docs, id_col, text_col, gram, seed), "importance-chunks", **SMALL_GROUPS)
        aim = common.written(chunks(target, None, text_col, gram, seed), "importance-target", **SMALL_GROUPS)
        words = common.written(dictionary(own, aim), "importance-words")
        if words.filter("word <> other").isEmpty():
            break
    tuples = _counts(own, "n", "0").unionByName(_counts(aim, "0", "n")).groupBy("tuple").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    grams = common.written(hashed(tuples, words, gram, buckets), "importance-grams")
    gains = common.written(gains_of(grams, buckets), "importance-gains")
    by_tuple = grams.filter("s > 0").join(F.broadcast(gains), "bucket").select("tuple", "gain")
    wanted = own.select("chunk", "seq", F.posexplode("grams").alias("k", "tuple"))
    # Place and gain in one number: gains are some thousands.
    place = F.col("seq").cast("bigint") * PIECE + F.col("k")
    gained = wanted.join(by_tuple, "tuple").select(F.col("chunk").alias("of"), F.shiftleft(place, 32).bitwiseOR(F.col("gain").bitwiseAND(0xFFFFFFFF)).alias("g"))
    bags = own.select("chunk", "seq", "doc_ids", "n_words", "n_features", "kinds", "bags")

    def weigh(bags: pa.Table, gained: pa.Table) -> pa.Table:
        """One chunk's documents."""
        bags, g = bags.sort_by("seq"), gained.column("g").to_numpy()
        flat = {k: pa.chunked_array([x.flatten() for x in bags.column(k).chunks]) for k in ("doc_ids", "n_words", "n_features", "kinds")}
        gain = np.zeros(len(g), np.int64)
        gain[g >> 32] = (g & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        own = [np.zeros(1, np.int64)]
        for row in bags.column("bags"):
            at, times = unpacked_bags(row.as_buffer())
            own.append(gain[at] * times)
        sums = np.cumsum(np.concatenate(own))
        kinds, features = flat["kinds"].to_numpy(), flat["n_features"].to_numpy()
        ends = np.cumsum(kinds, dtype=np.int64)
        weight = (sums[ends] - sums[ends - kinds]) // np.maximum(features, 1)
        return pa.table({"doc_id": flat["doc_ids"], "n_words": flat["n_words"], "n_features": flat["n_features"], "weight": weight})

    return bags.groupBy("chunk").cogroup(gained.groupBy("of")).applyInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def drawn(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = DRAW_SEED) -> DataFrame:
    """weighed with score and rank (1, 2, ... in order of score; null where it isn't drawn)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = common.written(weighed.withColumn("score", F.col("weight") + noise), "importance-scores")
    ready = scored.filter(F.col("n_words") >= least_words)
    most = ready.count() * percent // 100
    placed = windows.numbered(ready, [F.desc("score"), F.asc("doc_id"), F.asc("n_features")], "pos")
    rank = F.when(F.col("pos") < most, F.col("pos") + 1).alias("rank")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.select(*scored.columns, rank).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, buckets: int = BUCKETS, **draw) -> DataFrame:
    """The rows of docs that are drawn, by an id of their own, with all their columns."""
    no = common.fresh(docs, "row_no")
    rows = common.written(docs.withColumn(no, F.monotonically_increasing_id()), "importance-rows")
    chosen = drawn(weights(rows, target, no, text_col, gram, buckets), **draw).filter("rank is not null").select(F.col("doc_id").alias(no))
    return rows.join(chosen, no, "left_semi").select(*docs.columns)


def op12_word_id_importance(spark, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drawn(weights(common.documents(spark, sf_dir), target)).select("doc_id", "n_features", "weight", "score", "rank")


SQL = {
    "op12_word_id_importance": rf"""
WITH RECURSIVE c(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS crcs FROM c WHERE k = 8),
d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
o AS (SELECT no, unnest(ws) AS w FROM d),
n AS (SELECT no, w, count(*) AS n FROM o GROUP BY no, w),
u AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, n AS s, 0 AS t FROM n UNION ALL SELECT unnest(ws), 0, 1 FROM b) GROUP BY w),
x AS (SELECT w, s, t, hex(encode(w)) AS h FROM u),
k AS (SELECT w, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint)),
        lambda a, y: xor(a >> 8, crcs[(xor(a, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM x, tab),
g AS (SELECT bucket, sum(s)::double AS s, sum(t)::double AS t, sum(sum(s)) OVER ()::double AS all_s, sum(sum(t)) OVER ()::double AS all_t FROM k GROUP BY bucket),
v AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + {BUCKETS}) / ((s + 1) * (all_t + {BUCKETS})))) AS gain FROM g),
m AS (SELECT no, floor(sum(n * gain) / sum(n)) AS weight FROM n JOIN k USING (w) JOIN v USING (bucket) GROUP BY no),
f AS (SELECT d.no, doc_id, len(ws)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
        ('0x' || substr(sha256('{DRAW_SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM d LEFT JOIN m USING (no)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id, n_features) AS pos, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS ready FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND pos <= ready * {PERCENT} // 100 THEN pos END AS rank FROM r
"""
}
