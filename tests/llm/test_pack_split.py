import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from karst.llm import pack, split


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120), st.sampled_from([50, 64, 100]))
def test_plan_holds_every_item_and_no_more(items, capacity):
    sizes, demand = np.unique(np.array(items), return_counts=True)
    runs = pack.plan_runs("c", capacity, sizes, demand)
    n = int((runs.container_from + (runs.rank_to - runs.rank_from) // runs.per_container).max())
    fill, seen = np.zeros(n, int), {}
    for r in runs.itertuples():
        ranks = np.arange(r.rank_from, r.rank_to)
        np.add.at(fill, r.container_from + (ranks - r.rank_from) // r.per_container, r.size)
        seen[r.size] = seen.get(r.size, 0) + len(ranks)
    assert fill.max() <= capacity and fill.min() > 0 and seen == dict(zip(sizes.tolist(), demand.tolist()))


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    items = np.minimum(rng.geometric(0.02, 4000), 200)
    sizes, demand = np.unique(items, return_counts=True)
    used = sum(n for *_, n in pack.plan(sizes, demand, 200))
    assert used <= 1.02 * items.sum() / 200 + 1


def test_pack(spark):
    rows = [(i, 10) for i in range(40)] + [(100, 70), (101, None), (102, 0), (103, 25), (103, 25)]
    items = spark.createDataFrame(rows, "doc_id long, tokens int")
    caps = spark.createDataFrame([("a", 30), ("b", 1000), ("bad", None), ("zero", 0)], "capacity_name string, capacity_tokens int")
    out = pack.pack(items, caps, per_salt=7).toPandas()
    assert set(out.capacity_name) == {"a", "b"} and not set(out.doc_id) & {101, 102}
    size = {**{i: 10 for i in range(40)}, 100: 70, 103: 25}
    for name, g in out.groupby("capacity_name"):
        cap = {"a": 30, "b": 1000}[name]
        g = g.assign(n=g.to_token - g.from_token)
        assert g.groupby("container").n.sum().max() <= cap
        assert g.groupby("doc_id").n.sum().to_dict() == size
        assert sorted(g.container.unique()) == list(range(g.container.nunique()))
        assert (g.groupby("doc_id").size() > 1).to_dict() == {d: n > cap for d, n in size.items()}
    assert pack.pack(items.limit(0), caps).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n#-́中", max_size=300), st.integers(1, 60), st.integers(-3, 70))
def test_pieces_tile_the_text(text, limit, overlap):
    parts = split.pieces(text, limit, overlap)
    assert "".join(text[n:e] for _, n, e in parts) == text
    assert all(e - s <= limit for s, _, e in parts)
    lap = max(0, min(overlap, limit - 1))
    for (_, _, before), (s, n, _) in zip(parts, parts[1:]):
        assert n == before and s == max(0, n - lap)


def test_cuts_are_natural():
    text = "# A\n\n" + "One sentence here. " * 10 + "\n\n# B\n\n" + "Another one there. " * 10
    parts = split.pieces(text, 120, 0)
    assert any(text[a:].startswith("# B") for a, _, _ in parts)
    assert all(text[e - 1] in " \n" for _, _, e in parts[:-1])


def test_limits_and_defaults(spark):
    settings_ = spark.createDataFrame([("*", "chunk", 10, 2), ("n", "chunk", None, 3), ("m", "chunk", 5, None), ("m", "chunk", 6, None)], "namespace string, item_kind string, max_chars int, overlap_chars int")
    items = spark.createDataFrame(
        [("chunk", "a", "n", "x" * 11), ("chunk", "b", None, "x" * 10), ("chunk", "c", "m", "x" * 6), ("chunk", "c", "m", "x" * 6), ("chunk", "d", "q", None), ("page", "e", "n", "x" * 99)],
        "item_kind string, item_id string, namespace string, text string",
    )
    out = split.split_oversized(items, settings_).toPandas()
    assert sorted(set(out.item_id)) == ["a", "c"]
    a = out[out.item_id == "a"].sort_values("piece_no")
    assert list(a.start) == [0, 4] and list(a.new_from) == [0, 7]
    assert len(out[out.item_id == "c"]) == 2
    assert split.split_oversized(items.limit(0), settings_).count() == 0


def test_pieces_keep_to_the_bounds_of_split_nodes():
    text = "# A\n\n" + "One sentence here. " * 20 + "\n\n# B\n\n" + "Another one there. " * 3
    parts = split.pieces(text, 120, 10)
    b = text.index("# B")
    assert not any(new < b < end for _, new, end in parts)  # no piece straddles the section that was cut


def test_plan_is_level_with_best_fit_decreasing():
    import bisect

    rng = np.random.default_rng(5)
    for capacity in (1024, 2048):
        items = np.minimum(rng.gamma(2.0, capacity / 5, 6000).astype(int) + 1, capacity)
        rooms: list[int] = []
        used = 0
        for s in sorted(items.tolist(), reverse=True):
            i = bisect.bisect_left(rooms, s)
            room = rooms.pop(i) if i < len(rooms) else capacity
            used += room == capacity
            bisect.insort(rooms, room - s)
        sizes, demand = np.unique(items, return_counts=True)
        assert sum(n for *_, n in pack.plan(sizes, demand, capacity)) <= 1.002 * used
