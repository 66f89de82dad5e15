import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshspark.llm import packing, token_output
from meshspark.llm.tokens import Encoder, pack_ids, unpack_ids

ODD = ["", "a", " a", "a ", "a  b", "a   b", "a\n\nb", "a \nb", "a\n b", "a\n\n\nb", "x  ", "x\n\n", "\tq", "a\xa0b", "it's we'll", "don't 've", "é ñ ß", "Σίσυφος ΣΑΣ", "<|endoftext|>x", "x" * 3000, None, "1 2.3,4", "a\x00b", "日本 語", "e\u0301 x", "A\x1cB c", "\u3000x y", "THE,!! of%%% ##", "a\u2003b c", "“q” – r…", "x\n\n\n", "\n", " ", "\n a", "Ünï÷code ×Ñ", "İI\u0307", "12 345\n6"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choices(list("abÀ'.,!1 \n  \té漢"), k=rng.randint(1, 40))) for _ in range(800)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(name, texts, monkeypatch):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [x.tolist() for x in Encoder(path).ids(texts)] == want
    monkeypatch.setattr("meshspark.llm.tokens.STORE_BYTES", 2000)  # stores turn over all the time
    monkeypatch.setattr("meshspark.llm.tokens.SLICE_BYTES", 50)
    assert [x.tolist() for x in Encoder(path).ids(texts)] == want
    assert all(unpack_ids(pack_ids(np.array(w, dtype=np.uint32))).tolist() == w for w in [*want[:20], [70_000, 1]])


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    counts = (rng.pareto(0.6, 700) * 3).astype(np.int64)
    lengths = token_output.code_lengths(counts, 12)
    used = counts > 0
    assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max() <= 12
    assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
    free = token_output.code_lengths(counts, 40)
    import heapq

    heap = [(int(c), k, [k]) for k, c in enumerate(counts) if c]
    depth = np.zeros(700, dtype=int)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    assert (free * counts).sum() == (depth * counts).sum()
    assert token_output.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_block_round_trip():
    rng = np.random.default_rng(4)
    docs = [np.minimum(rng.zipf(1.3, n), 5000).astype(np.uint32) for n in (1, 0, 127, 128, 129, 1000, 5)]
    counts = np.bincount(np.concatenate(docs))
    lengths = token_output.code_lengths(counts)
    block = token_output.write_block([5, None, 7, 8, 9, -1, 10], docs, lengths, token_output.canonical_codes(lengths))
    ids, sizes, flat = token_output.read_block(block, token_output.decode_table(lengths))
    assert ids == [5, None, 7, 8, 9, -1, 10] and sizes.tolist() == [len(d) for d in docs]
    assert (flat == np.concatenate(docs)).all()


def rows(texts):
    return [(k * 3, t, None if k % 7 == 0 else f"s{k % 3}", k) for k, t in enumerate(texts)] + [(None, "no id here", "s1", -1), (6, "again", "s1", -2)]


SCHEMA = "doc_id long, text string, source string, n_tokens int"


def test_token_output(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    data = rows(texts)
    got = token_output.round_trip(spark.createDataFrame(data, SCHEMA).repartition(5), path).collect()
    plain = Tokenizer.from_file(path)
    want, at = [], 0
    for doc_id, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.round_trip(spark.createDataFrame([], SCHEMA), path).collect() == []


def test_packing(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    data = rows(texts + ["long words " * 9000])
    pieces = packing.pack(spark.createDataFrame(data, SCHEMA).repartition(5), path)
    got = pieces.collect()
    plain = Tokenizer.from_file(path)
    total = 0
    for doc_id, text, *_ in data:
        if doc_id is None or doc_id == 6:
            continue
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((p for p in got if p.doc_id == doc_id), key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist() and {p.doc_tokens for p in own} == {len(ids)}
    by: dict = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
        total += p.length
    assert sorted(by) == list(range(len(by)))
    short = [by[k] for k in sorted(by) if by[k] != 2048]
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    assert sum(map(len, (r.ids for r in packing.sequences(pieces).collect()))) == total
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).collect() == []


def test_rounds_hold_the_mixture(spark):
    sized = spark.createDataFrame([(k, k, f"s{k % 2 if k % 5 else 2}", 100 + k % 900) for k in range(2000)], "rid long, doc_id long, source string, size long")
    packets, total = packing.rounds(sized, 2048, 16 * 2048)
    p = packets.toPandas()
    assert p["size"].sum() == total and sorted(p["position"]) == np.cumsum([0, *p.sort_values("position")["size"]])[:-1].tolist()
    share = p.groupby("source")["size"].sum() / total
    p["window"] = p["position"] // (16 * 2048)
    for _, w in list(p.groupby("window"))[:-1]:
        got = w.groupby("source")["size"].sum() / w["size"].sum()
        assert (abs(got - share) < 0.1).all()


def test_windows_hold_given_proportions(spark):
    weights = {"s0": 0.6, "s2": 0.1}
    sized = spark.createDataFrame([(k, k, ["s0", "s1", "s1", "s2", None][k % 5], 100 + k % 900) for k in range(4000)], "rid long, doc_id long, source string, size long")
    packets, total = packing.rounds(sized, 2048, 16 * 2048, weights)
    p = packets.toPandas()
    assert p["size"].sum() == total and sorted(p["position"]) == np.cumsum([0, *p.sort_values("position")["size"]])[:-1].tolist()
    p["source"] = p["source"].fillna("none")
    size = p.groupby("source")["size"].sum()
    weight = {s: weights.get(s, size[s] / total) for s in size.index}
    p["window"] = p["position"] // (16 * 2048)
    done = {s: 0.0 for s in size.index}
    for _, w in p.sort_values("position").groupby("window"):
        # credit goes to the queues that still hold packets; what a window leaves is carried on
        room = float(w["size"].sum())
        while room > 1e-6:
            active = [s for s in size.index if done[s] < size[s] - 1e-6]
            if not active:
                break
            whole = sum(weight[s] for s in active)
            step = min([room, *[(size[s] - done[s]) * whole / weight[s] for s in active]])
            for s in active:
                done[s] += step * weight[s] / whole
            room -= step
        out = p[p["window"] <= w["window"].iloc[0]].groupby("source")["size"].sum()
        assert all(abs(out.get(s, 0) - done[s]) < 2 * 2048 for s in size.index)
    with pytest.raises(ValueError):
        packing.rounds(sized, weights={"s0": 0.0})
