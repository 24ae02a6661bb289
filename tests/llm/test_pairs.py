"""Jaccard join, components and decontamination against brute force."""

import glob
import random
import time
from collections import defaultdict

import numpy as np
import pytest

from citespan.llm import components, decontamination, jaccard_join, wordhash

WORDS = [f"w{i}" for i in range(400)]


def brute(rows):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and (a == b or 5 * len(a & b) >= 4 * len(a | b) and a):
                links[i].add(j)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((d, min(rows[j][0] for j in seen), len(links[i])))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.choice((3, 5, 40, 90)))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    return rows + [(1000, ""), (1001, None), (1002, "  \n"), (1003, "É é"), (1004, "é É"), (1005, "x " * 30000), (1006, "x " * 30000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(frame, seed, monkeypatch):
    rows = corpus(seed)
    df = frame([(d, t, t) for d, t in rows], "doc_id long, text string, class_id string")
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(df).collect())
    assert got == brute(rows)


def test_near_duplicates_leave_no_shuffle_files(spark, frame):
    """What the steps before the last shuffle goes with them, whenever the driver's garbage is collected; a task that
    its query no longer waits for can leave a file."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    before, was = files(), spark.conf.get(name)
    jaccard_join.near_duplicates(frame(corpus(4), "doc_id long, text string"))
    until = time.time() + 20
    while len(files() - before) > 9 and time.time() < until:
        time.sleep(0.2)
    assert len(files() - before) <= 9 and spark.conf.get(name) == was


def test_blocks_of_a_large_component(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rows = corpus(3, 150)
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(frame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_near_duplicates_of_odd_tables(frame):
    assert jaccard_join.near_duplicates(frame([], "doc_id long, text string")).count() == 0
    got = [tuple(r) for r in jaccard_join.near_duplicates(frame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, None, 0), (1, 1, 1), (1, 1, 1)], key=str)
    kept = jaccard_join.keep_one(frame([(2, "a b"), (1, "A b!"), (1, "A b!"), (3, "c"), (None, "a b")], "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "A b!"), (3, "c"), (None, "a b")], key=str)


def test_least_depth():
    k = jaccard_join.least_depth()
    assert jaccard_join.found_at(k, 0.8) >= jaccard_join.TARGET > jaccard_join.found_at(k + 1, 0.8)


@pytest.mark.parametrize("partitions", [1, 8])
def test_trie_members_share_a_prefix(spark, frame, partitions):
    rng = np.random.default_rng(partitions)
    signatures = {}
    for i in range(60):
        own = rng.integers(0, 3, (jaccard_join.TREES, jaccard_join.DEPTH)).astype(">u2")
        signatures[i] = signatures[i - 1].copy() if i % 5 == 1 else own
        if i % 5 == 1:
            signatures[i][:, 6:] = own[:, 6:]
    classes = frame([(i, bytearray(x.tobytes())) for i, x in signatures.items()] + [(99, bytearray())], "node long, labels binary")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        members = jaccard_join.trie_members(classes, 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for depth in range(3, jaccard_join.DEPTH + 1):
        for tree in range(jaccard_join.TREES):
            below = defaultdict(set)
            for i, x in signatures.items():
                below[x[tree, :depth].tobytes()].add(i)
            assert {m.node for m in members if m.tree == tree and m.depth >= depth} == {i for group in below.values() if len(group) > 1 for i in group}


def boilerplate(n, seed=7):
    """Texts that are pairwise near 0.4, and near copies of every 40th."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(common + [f"o{i}x{rng.randrange(10**6)}" for _ in range(90)])) for i in range(n)]
    return rows + [(10_000 + i, rows[i][1] + " and more") for i in range(0, n, 40)]


def test_boilerplate_falls_apart(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    sizes = {}
    for n in (200, 400):
        df = frame(boilerplate(n), "doc_id long, text string").select("doc_id", "text")
        signed = df.mapInArrow(jaccard_join._signatures, jaccard_join._SIGNED)
        classes = signed.selectExpr("doc_id AS node", "labels").cache()
        parts = jaccard_join.candidates(classes, jaccard_join.trie_members(classes, 4), 4).groupBy("component").count().collect()
        sizes[n] = sum(r["count"] for r in parts)
        assert max(r["count"] for r in parts) <= 4 and 2 * n // 40 <= sizes[n] <= 3 * n // 40
    rows, told = boilerplate(200), {}
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(frame(rows, "doc_id long, text string"), told).collect()) == brute(rows)
    assert told["recall"] >= jaccard_join.TARGET and jaccard_join.least_depth() <= told["depth"] <= jaccard_join.DEPTH


def test_prefix_is_shortened_until_the_recall(spark):
    def members(trees, n):
        return spark.createDataFrame([(a, tree) for a in range(n) for tree in range(trees)], "node long, tree int")

    floor = jaccard_join.least_depth()
    # Neighbours in all trees are copies but for a word: the full prefix; in few of them: a shorter one.
    assert jaccard_join.estimated_depth(members(jaccard_join.TREES, 100), floor) == jaccard_join.DEPTH
    assert jaccard_join.estimated_depth(members(10, 100), floor) == floor
    assert floor < jaccard_join.estimated_depth(members(19, 100), floor) <= jaccard_join.DEPTH


def test_components(frame):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(300, 301 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(frame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert components.components(frame([], "a long, b long")).count() == 0


def test_word_hashes():
    one = wordhash.word_hashes("Hello, wörld_1 hello\U0001d11eHELLO")
    assert len(one) == 4 and one[0] == one[2] == one[3] and len(np.unique(one)) == 2 and len(wordhash.word_hashes("")) == 0


ITEM = "Anna has 3 apples and buys 4 kg of pears for Anna before the long lunch today"


def hits(docs, items, frame, **more):
    got = decontamination.matches(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), **more)
    return sorted((r.doc_id, r.item_id) for r in got.collect())


def test_reparameterised_questions(frame):
    same = "Intro words here. So Bob has 12 apples and buys 9.5 lb of pears for Bob before the long lunch today and more"
    mixed = "Intro words here. So Bob has 12 apples and buys 9.5 lb of pears for Eve before the long lunch today and more"
    other = "Nothing of the sort stands in this text, which is about quite other things than fruit"
    docs = [(1, ITEM.lower()), (2, "x " * 20000 + same), (3, mixed), (4, other), (5, None), (6, ""), (None, ITEM), (7, "so. " + ITEM), (7, "so. " + ITEM)]
    assert hits(docs, [(0, "So " + ITEM), (1, None), (2, ""), (None, ITEM)], frame) == [(1, 0), (2, 0), (7, 0)]
    assert hits([], [(0, ITEM)], frame) == [] and hits(docs, [], frame) == []


def test_short_items(frame):
    items = [(0, "What is the capital of France?"), (1, "Purple elephants dance"), (2, "42"), (3, "Who wrote 1984")]
    docs = [(0, "Some words before it. What is the capital of France? And some more words after it."), (1, "long ago purple elephants dance in the rain with others"), (2, "it was 17 or 18 of all these many words"), (3, "it was 42 of all these many words"), (4, "what is the capital city of France, they asked of all the others")]
    assert hits(docs, items, frame) == [(0, 0), (1, 1), (3, 2)]


def test_names_at_the_start_of_sentences_and_lines(frame):
    item = "Tom has 3 apples. Tom buys 4 more. Tom eats 2. How many are left?"
    wrapped = "The long way home from school was walked by McGee and the dog of Anna at noon"
    docs = [(0, item.replace("Tom", "Ann")), (1, "Before it. " + item.replace("Tom", "Ann").replace("3", "7")), (3, wrapped.replace("by McGee", "by\nMcGee").replace("of Anna", "of\nAnna")), (4, wrapped.lower()), (5, wrapped.replace("McGee", "DeWitt"))]
    assert hits(docs, [(0, item), (1, wrapped)], frame) == [(0, 0), (1, 0), (3, 1), (4, 1), (5, 1)]


def test_contamination_against_brute_force(frame):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS[:60]).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    items = [(i, say(rng.randint(12, 30))) for i in range(15)]
    docs = []
    for d in range(60):
        i = rng.randrange(15)
        words = items[i][1].split()
        part = words[: int(len(words) * rng.choice((0, 0.2, 0.4, 0.6, 0.8, 1)))]
        docs.append((d, f"{say(20)} {' '.join(part)} {say(15)}"))

    def covered(doc, item):
        a, b, best = doc.split(), item.split(), 0
        for shift in range(-len(b), len(a)):
            on = set()
            for s in range(len(b) - 7):
                if 0 <= s + shift and a[s + shift : s + shift + 8] == b[s : s + 8]:
                    on |= set(range(s, s + 8))
            best = max(best, len(on))
        return best >= 0.5 * len(b)

    assert hits(docs, items, frame) == sorted((d, i) for d, t in docs for i, x in items if covered(t, x))


def test_slots_are_judged_by_vote_in_any_order():
    rng = random.Random(2)
    name, a, b, c = 2, 11, 12, 13

    def windows(values, size=8):
        """The windows of an item whose placeholders stand at these places: {place: (item value, doc value)}."""
        slots = lambda at, k: [(name, v[k], p) for p, v in sorted(values.items()) if at <= p < at + size]
        return [(at, slots(at, 0), slots(at, 1)) for at in range(53)]

    once = windows({10: (1, a), 20: (1, a), 30: (1, a), 40: (2, b), 50: (1, a)})
    typo = windows({10: (1, a), 20: (1, a), 30: (1, a), 40: (1, c), 50: (1, a)})
    mixed = windows({3: (1, b), 40: (1, a)})
    merged = windows({10: (1, a), 40: (2, a)})
    for hits_, want in ((once, (53, 60)), (typo, (45, 59)), (mixed, None), (merged, None)):
        for _ in range(5):
            assert decontamination.judge(rng.sample(hits_, len(hits_)), 60, 8) == want
    numbers = [(at, [(1, x, p) for x, _, p in slots], [(1, y, p) for y, _, p in other]) for at, slots, other in [(at, [(v, 0, p) for _, v, p in s], [(w, 0, p) for _, w, p in t]) for at, s, t in merged]]
    assert decontamination.judge(numbers, 60, 8) == (53, 60) and decontamination.judge([(0, [], [])], 8, 8) == (1, 8)


def test_an_item_many_times_over_in_one_text(frame):
    docs = [(1, (ITEM + " and so on. ") * 3000), (2, ITEM[:20])]
    assert hits(docs, [(0, ITEM)], frame) == [(1, 0)]


def test_placeholders_alone_match_nothing(frame):
    """Lists of other numbers or names aren't the item's; its own list is, and so is the question with other numbers."""
    items = [(1, "Sort the list 12 7 9 33 5 8 2 1 4 6 now"), (2, "Anna has 3 apples and buys 4 more at the shop before she eats 2 of them on the way home")]
    numbers = " ".join(str(i * 7 % 100) for i in range(2000))
    docs = [
        (1, "Scores were 91 82 73 64 55 46 37 28 19 10 in the table"), (2, numbers), (3, "so: sort the list 12 7 9 33 5 8 2 1 4 6 now, please"),
        (4, "They said: Berta has 8 apples and buys 9 more at the shop before she eats 5 of them on the way home."), (5, "At 12 7 9 33 5 8 2 1 4 6 it ended"),
    ]
    docs_df, item_df = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs_df, item_df).collect()}
    assert got == {(3, 1), (4, 2), (5, 1)}


def test_hits_of_numbers_are_linear():
    """Windows of number tables aren't alike: none of them is a template of placeholders."""
    text = decontamination.Canonical(" ".join(str(i * i % 9973) for i in range(2000)))
    hashes = np.concatenate([form.windows(8)[at] for form, at in text.forms(8)])
    assert len(hashes) == 1993 and len(set(hashes.tolist())) > 1900


def test_keep_one_of_ids_that_stand_twice(frame):
    long = "the very same sentence of ten words stands right here now"
    rows = [(1, "one text of its own that is about nothing much"), (1, "quite another text under that id which stays as well"), (1, "one text of its own that is about nothing much"), (2, long), (2, long + " again"), (3, long), (None, long)]
    kept = jaccard_join.keep_one(frame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept_id int"))
    assert kept.columns == ["doc_id", "text", "kept_id"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len(got) == 4 and got[:2] == [(1, rows[0][1]), (1, rows[1][1])] and got[2][0] == 2 and got[3] == (None, long)


def test_decontaminate_keeps_the_rest(frame):
    docs = frame([(1, "so. " + ITEM, "a"), (2, "clean", "b"), (None, ITEM, "c")], "doc_id long, text string, bad_id string")
    out = decontamination.decontaminate(docs, frame([(0, "So. " + ITEM)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r.bad_id for r in out.collect()) == ["b", "c"]
