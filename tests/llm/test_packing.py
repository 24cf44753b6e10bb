import random

import pytest

from tarnwell.llm import packing


def test_histogram_patterns():
    r = random.Random(3)
    for capacity in (10, 64, 2048):
        for _ in range(3):
            histogram = {length: r.randint(1, 50) for length in r.sample(range(1, capacity + 1), min(capacity, 40))}
            patterns = packing.pack_histogram(histogram, capacity)
            held = {}
            for p in patterns:
                assert 0 <= p.left == capacity - sum(n * t for n, t in p.items) and p.count > 0
                for n, t in p.items:
                    held[n] = held.get(n, 0) + t * p.count
            assert held == histogram
    with pytest.raises(ValueError, match="no container"):
        packing.pack_histogram({11: 1}, 10)
    assert packing.pack_histogram({}, 10) == []


def test_each_item_goes_to_the_shortest_pack():
    r = random.Random(8)
    histogram = {length: r.randint(1, 9) for length in r.sample(range(1, 200), 30)}
    packs: list[list[int]] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            shortest = min(packs, key=sum, default=None)
            if shortest is not None and sum(shortest) + length <= 200:
                shortest.append(length)
            else:
                packs.append([length])
    found = packing.pack_histogram(histogram, 200)
    assert sorted(p.left for p in found for _ in range(p.count)) == sorted(200 - sum(p) for p in packs)


def test_pack(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["page", "retrieval", "of", "字"]) for _ in range(r.choice([1, 3, 20, 300, 5000])))) for i in range(120)] + [(500, ""), (501, None), (0, "page")]
    rows = rows[1:] + [rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack(df).toPandas()
    sizes = {d: s for d, s in packing.token_counts(df).distinct().collect()}
    by_doc = found.groupby("doc_id").n_tokens.sum().to_dict()
    assert by_doc == sizes and found.duplicated(["doc_id", "piece_index"]).sum() == 0
    for d, own in found.groupby("doc_id"):
        own = own.sort_values("piece_index")
        assert (len(own) == 1 or sizes[d] > packing.CAPACITY) and (own.n_tokens.iloc[:-1] == packing.CAPACITY).all() and (own.first_token == own.piece_index * packing.CAPACITY).all()
    placed = found[found.container_id.notna()]
    assert set(found[found.container_id.isna()].doc_id) == {500, 501}
    for _, own in placed.groupby("container_id"):
        own = own.sort_values("place")
        ends = own.place + own.n_tokens
        assert (own.place.iloc[1:].to_numpy() == ends.iloc[:-1].to_numpy()).all() and ends.max() <= packing.CAPACITY
    used = placed.n_tokens.sum() / (placed.container_id.nunique() * packing.CAPACITY)
    assert used > 0.9
    usage = packing.container_usage(packing.pack(df)).toPandas()
    assert usage.n_tokens.sum() == placed.n_tokens.sum()
    assert packing.pack(df.limit(0)).count() == 0


def test_pieces_decode_to_the_text():
    encoding = packing.load_tokenizer(packing.default_ranks())
    text = "retrieval of pages 字 " * 1500
    ids = encoding.encode_ordinary(text)
    assert b"".join(encoding.decode_bytes(ids[i : i + packing.CAPACITY]) for i in range(0, len(ids), packing.CAPACITY)).decode() == text
