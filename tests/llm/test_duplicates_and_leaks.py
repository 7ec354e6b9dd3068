"""Chosen-path join and decontamination against brute force."""

import random

import pytest

from livetick.llm import chosen_path, decontaminate
from livetick.llm.components import components

RANDOM = random.Random(8)


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links) of (doc_id, text) rows."""
    sets = [(i, shingles(t) if i is not None else frozenset()) for i, t in rows]
    links, group = [0] * len(sets), list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                group[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((-1 if i is None else i), low.get(find(k), -1), links[k]) for k, (i, _) in enumerate(sets))


def result(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select("doc_id", "class_id", "n_links").collect())


def near_copies(base, edits, copies, start):
    out = []
    for k in range(copies):
        words = list(base)
        for _ in range(RANDOM.randrange(edits + 1)):
            words[RANDOM.randrange(len(words))] = f"new{RANDOM.random()}"
        out.append((start + k, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def crowd():
    rows = []
    for g in range(6):
        base = [f"w{RANDOM.randrange(5000)}" for _ in range(120)]
        rows += near_copies(base, 2 + g, 25, 1000 * g)
        rows += [(1000 * g + 500 + k, " ".join(base)) for k in range(20)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(90_000 + k, passage + " " + " ".join(f"x{RANDOM.randrange(9999)}" for _ in range(60))) for k in range(60)]
    return rows


def test_join(spark, odd, none, documents, crowd):
    assert result(chosen_path.near_duplicates(none)) == []
    for rows in (crowd, [(r["doc_id"], r["text"]) for r in odd.collect()], [(r["doc_id"], r["text"]) for r in documents.collect()]):
        assert result(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_join_does_not_depend_on_sizes(spark, crowd, monkeypatch):
    frame, want = spark.createDataFrame(crowd, "doc_id bigint, text string"), brute(crowd)
    for members, tokens in ((10, 1 << 20), (1024, 2000)):
        monkeypatch.setattr(chosen_path, "MEMBERS", members)
        monkeypatch.setattr(chosen_path, "TOKENS", tokens)
        assert result(chosen_path.near_duplicates(frame)) == want


def test_recall_bound():
    assert chosen_path.missed(0.8) ** chosen_path.runs_for(0.8, 0.999) <= 0.001


def test_keep_first(spark, odd, crowd):
    kept = chosen_path.keep_first(odd)
    assert kept.columns == odd.columns
    # Of the two equal rows 5 and of 6, which is as similar, one stays.
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]
    frame = spark.createDataFrame(crowd, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in chosen_path.keep_first(frame).collect()) == sorted({c for _, c, _ in brute(crowd)})


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (105, 100), (200, 200)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102, 105)}}


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages(spark, documents, data_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").limit(12).collect()]
    items += [(900, "tiny"), (901, None), (902, ""), (903, "a somewhat short item"), (None, items[0][1])]
    rows = []
    for k, r in enumerate(documents.where("length(text) < 1200").limit(40).collect()):
        item = list(decontaminate.plain(RANDOM.choice(items[:12])[1]))
        for _ in range(RANDOM.randrange(int(len(item) * 0.16))):
            at, what = RANDOM.randrange(len(item)), RANDOM.random()
            item[at : at + (what < 0.7)] = [] if what < 0.35 else [RANDOM.choice("xyz")]
        at = RANDOM.randrange(len(r["text"]))
        rows.append((k, r["text"][:at] + " " + "".join(item).upper() + "\n " + r["text"][at:]))
    rows += [(100, None), (101, ""), (None, items[3][1]), (102, "so Tiny  a thing"), (103, "filler " * 20_000 + items[4][1]), (103, items[5][1])]
    want = []
    for i, text in rows:
        for j, item in items:
            item, plain = decontaminate.plain(item), decontaminate.plain(text)
            if not item or len(plain) > 20_000 and item not in plain:
                continue
            edits = 0 if item in plain else distance(item, plain) if len(item) >= decontaminate.Q else 99
            if edits <= decontaminate.budget(len(item)):
                want.append((i, j, edits))
    key = lambda x: [-1 if v is None else v for v in x]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, item_id int, edits int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.matches(docs, bench)
    assert sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()), key=key) == sorted(want, key=key)
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    held = {i for i, _, _ in want}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, t in rows if i not in held)
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_passages_over_several_parts(spark, documents, data_dir, monkeypatch):
    bench = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.matches(documents, bench).collect()))
    parts = list(decontaminate.parts_of(bench, 2000))
    monkeypatch.setattr(decontaminate, "parts_of", lambda _: parts)
    monkeypatch.setattr(decontaminate, "SLICE", 5000)
    assert len(parts) > 1 and want
    assert sorted(map(tuple, decontaminate.matches(documents, bench).collect())) == want


def test_two_differing_coordinates_do_not_lose_a_pair(spark, monkeypatch):
    """Pairs that share all sampled tokens but two, in nodes that part several times."""
    monkeypatch.setattr(chosen_path, "MEMBERS", 4)
    draw = random.Random(3)
    rows = [(k, 9, [0 if draw.random() < 0.4 else draw.getrandbits(40) for _ in range(64)]) for k in range(100, 1300)]
    for j in range(8):
        rows += [(2 * j + k, 9, [0] * 2 * j + [1 + 2 * j + k] * 2 + [0] * (62 - 2 * j)) for k in (0, 1)]
    classes = spark.createDataFrame(rows, "uid bigint, n bigint, sampled array<bigint>")
    nodes = {}
    for r in chosen_path.leaves(classes, chosen_path.runs_for(0.8, 0.999)).where("uid < 16").collect():
        nodes.setdefault(r["uid"], set()).add(r["node"])
    assert [j for j in range(8) if nodes.get(2 * j, set()).isdisjoint(nodes.get(2 * j + 1, set()))] == []


def test_links_are_counted_once_where_a_block_is_empty(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "TOKENS", 150)
    rows = []
    for g in range(8):
        base = [f"g{g}w{k}" for k in range(120)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, "more"]))]
    assert result(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_keep_first_goes_by_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (7, b), (7, b + " end"), (8, b), (8, c), (9, a + " end"), (9, None), (9, "")]
    kept = sorted(((r["doc_id"], r["text"] or "") for r in chosen_path.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    one = [k for k in kept if k[0] == 7]
    assert one in ([(7, b)], [(7, b + " end")])
    assert kept == sorted([(3, a), *one, (8, c), (9, ""), (9, "")])


@pytest.mark.parametrize("length", [120, 230, 350])
def test_passages_with_all_edits_at_any_place(length):
    """Evenly spaced deletions at the budget, over all places of a passage's diagonals within a band."""
    draw = random.Random(length)
    item = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
    edits = decontaminate.budget(length)
    gone = {round((k + 0.5) * length / edits) for k in range(edits)}
    passage = "".join(c for k, c in enumerate(item) if k not in gone)
    items = decontaminate.Items([(1, item)])
    for before in range(2 * edits + 1):
        assert [h[:2] for h in items.search(["7" * before + passage + "8" * 50])] == [(0, 1)], before


def test_end_of_an_item_alone_is_no_passage():
    item = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    assert decontaminate.Items([(1, item)]).search([item[-60:]]) == []


def test_templated_items_runs_and_equal_items(monkeypatch):
    """q-grams that all items share, q-grams that one item repeats, more equal items than a part has distinct ones."""
    template = "please read the terms of use of this page with care before you go on to item number {}"
    items = [(n, template.format(n)) for n in range(40)]
    texts = [(template.format(7) + " and on. ") * 3, ("please read the terms of use of this page with care before going on. " * 8)[:560], "nothing"]
    run = [(1, "a" * 300), (2, "ab" * 150)]
    runs = ["a" * 2000, "ab" * 900 + "a" * 280 + "b" + "a" * 19, "b" * 500]
    for own, found_in in ((items, texts), (run, runs)):
        index = decontaminate.Items(own)
        got = {(t, i): edits for t, i, _, edits in index.search(found_in)}
        for t, text in enumerate(found_in):
            for i, item in own:
                plain, most = decontaminate.plain(text), decontaminate.budget(len(item))
                edits = 0 if item in plain else distance(item, plain)
                assert got.get((t, i), 99) == (edits if edits <= most else 99)
        monkeypatch.setattr(decontaminate, "HITS", 1000)
        monkeypatch.setattr(decontaminate, "ALIGNED", 500)
        assert {(t, i): e for t, i, _, e in index.search(found_in)} == got
        monkeypatch.undo()
    equal = decontaminate.Items([(n, "seventy  thousand equal items of one Text") for n in range(70_000)])
    assert {i for _, i, _, e in equal.search(["x seventy thousand equal items of one text y"])} == set(range(70_000))


def test_parts_keep_equal_and_nameless_items(spark):
    bench = spark.createDataFrame([(1, "an item of some length"), (2, "an item of some length"), (None, "an item of some length"), (3, "other items are longer")], "item_id int, text string")
    for each in (10, 1 << 20):
        found = [row for part in decontaminate.parts_of(bench, each) for row in part.search(["here is an item of some length."])]
        assert sorted((r[1] is None, r[1]) for r in found) == [(False, 1), (False, 2), (True, None)]
