import hashlib
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.llm import spans, suffix_dedup

STRINGS = st.lists(st.binary(min_size=1, max_size=30) | st.text("ab", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=8)


@given(STRINGS)
@settings(max_examples=300, deadline=None)
def test_suffix_array_and_matches(strings):
    text, bounds = spans.joined(strings)
    suffixes = [(strings[k][i:], k, int(bounds[k]) + i) for k in range(len(strings)) for i in range(len(strings[k]))]
    assert suffix_dedup.suffix_array(text, bounds).tolist() == [x[2] for x in sorted(suffixes)]
    got = suffix_dedup.RunIndex(text, bounds).matching_statistics().tolist()
    for s, _, at in suffixes:
        want = 0
        for other, _, o in suffixes:
            if o != at:
                k = 0
                while k < min(len(s), len(other)) and s[k] == other[k]:
                    k += 1
                want = max(want, k)
        assert got[at] == want


def brute(texts, length):
    where = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            where[t[i : i + length]] += 1
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_query_is_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(rng.randrange(1, 60)))
        for p in rng.sample(passage, rng.randrange(3)):
            k = rng.randrange(len(p) // 2)
            t += p[k:] + word()
        rows.append((i, t))
    rows += [(100, "ab" * 100), (101, None), (102, ""), (None, passage[0]), (7, rows[7][1]), (103, "x\0y" * 40), (104, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int")
    for length, gram, size in ((20, 5, 300), (40, 12, 1 << 20)):
        got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.removed(docs, length=length, gram=gram, index_bytes=size).collect())
        want = brute([(t or "").encode() for _, t in rows], length)
        assert got == sorted(str((i, *w)) for (i, _), w in zip(rows, want))
    assert suffix_dedup.removed(docs.limit(0)).count() == 0


def test_many_equal_rows_and_filters_in_ranges(spark, monkeypatch):
    """Equal rows make one set of marks, not one for each of them; filters in ranges change nothing; ids beyond 2^53 stay."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    hot, passage = some(700), some(260)
    rows = [(5, hot)] * 1000 + [((1 << 60) + 1, some(100) + passage + some(90)), (None, passage + some(300)), (8, some(400)), ((1 << 60) + 2, hot + some(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(str((i, *w)) for (i, _), w in zip(rows, brute([t.encode() for _, t in rows], suffix_dedup.LENGTH)))
    tables, sizes = suffix_dedup.common.written, {}

    def watched(df, name, *rest):
        out = tables(df, name, *rest)
        sizes[name] = out.count() + (out.selectExpr("sum(size(runs))").first()[0] or 0 if name == "suffix-runs" else 0)
        return out

    monkeypatch.setattr(suffix_dedup.common, "written", watched)
    for bits in (suffix_dedup.FILTER_BITS, 1 << 15):
        got = suffix_dedup.removed(docs, filter_bits=bits).collect()
        assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
        assert max(sizes[x] for x in ("suffix-candidates", "suffix-contexts", "suffix-runs")) < 400


def test_common_string_between_different_neighbours(spark, monkeypatch):
    """Its contexts exceed an index; they are spread over keys that don't, and nothing is lost."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common_one, long_one = some(150), some(230)
    texts = [some(rng.randrange(150, 300)) + common_one + some(rng.randrange(150, 300)) for _ in range(300)]
    texts += [some(rng.randrange(100, 200)) + long_one + some(rng.randrange(100, 200)) for _ in range(60)]
    texts += [texts[5][100:] + some(50), texts[7], texts[7], common_one + "=" * 700, "-" * 300 + common_one + "=" * 650]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    limit, sizes, tables = 1 << 14, [], suffix_dedup.common.written

    def watched(df, name, *rest):
        out = tables(df, name, *rest)
        if name == "suffix-contexts":
            indexed = out.filter("not heavy") if "heavy" in out.columns else out
            sizes.append(indexed.groupBy("h").agg({"bytes": "count"}).agg({"count(bytes)": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(suffix_dedup.common, "written", watched)
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.removed(docs, index_bytes=limit).collect())
    want = brute([t.encode() for _, t in rows], suffix_dedup.LENGTH)
    assert got == sorted(str((i, *w)) for (i, _), w in zip(rows, want))
    assert max(sizes) <= limit // suffix_dedup.LENGTH
