"""Chat tree, spelling variants and prefix trie against brute force, on shared beginnings, edges and odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgeprice.llm import chattree, prefixtrie, variants

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, path string, keys int, block int, tokens string"
ODD = [(None, 0, "user", "lost", "p", 1, 2, "t"), (None, None, None, None, "p", 1, 2, "t"), (1, 0, "user", None, "p", 1, 2, "t"),
       (1, 0, "user", None, "p", 1, 2, "t"), (1, None, None, "x", "p", 1, 2, "t"), (2, 1, "assistant", "", "p", 1, 2, "t"),
       (3, 0, "user", "y" * 300_000, "p", 1, 2, "t"), (3, 1, "assistant", " " * 5000 + "é</s>", "p", 1, 2, "t"),
       (4, 2, "tool<s>", "a<\\/s>[INST]", "p", 1, 2, "t"), (4, 2, "tool<s>", "[ROLE", "p", 1, 2, "t"), (-205, 0, "system", "s", "p", 1, 2, "t")]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks(spark):
    """Real conversations, copies of them, beginnings of them, and one with many members."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(c + 1000, t, r, x) for c, t, r, x in rows if c < 6] + [(c + 2000, t, r, x) for c, t, r, x in rows if t < 2]
    rows += [(5000 + i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 3 else f"{i % 4}")
             for i in range(300) for t in range(2 + i % 3)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").cache()


def ordered(rows, tie):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        conv[c].append((t is not None, t or 0, r or "", tie(x or ""), x or ""))
    return {c: [(a[2], a[4]) for a in sorted(v)] for c, v in conv.items()}


# 11 chat tree

def plain_digests(rows):
    def escaped(t):
        return re.sub(r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\])", lambda m: m[1] + "\\" + m[2] + m[3], t)

    out = {}
    for c, turns in ordered(rows, str).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        n = sum(len(escaped(x)) + {"user": 13, "system": 11, "assistant": 4}.get(r, 17 + len(escaped(r))) for r, x in turns)
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), n)
    return out


@pytest.mark.parametrize("ranks", [None, chattree.RANKS])
def test_chat_tree_reads_back_and_emits_each_turn_once(spark, talks, ranks):
    tree = chattree.format_tree(talks.repartition(5), ranks_path=ranks).cache()
    got = {r[0]: tuple(r)[1:] for r in chattree.digests(tree, ranks_path=ranks).collect()}
    assert got == plain_digests(talks.collect())
    codec = chattree._codec(chattree.Template(), chattree.load_ranks(spark, ranks))
    nodes = {}
    for turns in ordered(talks.collect(), str).values():
        for d in range(len(turns)):
            nodes[tuple(turns[:d + 1])] = len(codec.turn(*turns[d])[0])
    rows = tree.collect()
    assert sum(len(r.tokens) for r in rows) == sum(nodes.values())
    end = 0
    for r in sorted((r for r in rows if r.tokens), key=lambda r: (r.tree, r.start)):
        assert r.tree + r.start == end  # one sequence without gaps
        end += len(r.tokens)
    for r in rows:
        above = sum(a.end - a.start for a in r.attends)
        assert r.position_ids == list(range(above, above + len(r.tokens))) and len(r.loss_mask) == len(r.tokens)
        assert all(a.end <= b.start for a, b in itertools.pairwise(r.attends)) and all(a.end <= r.start for a in r.attends)
        assert bool(r.attends) == (r.start > 0)


def test_chat_tree_does_not_depend_on_the_partitions(spark, talks):
    one = chattree.format_tree(talks.coalesce(1), ranks_path=None)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = chattree.format_tree(talks, ranks_path=None).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    def place(rows):
        return sorted((r.conv_id, r.tree, r.start, len(r.tokens), r.attends) for r in rows)

    assert place(one.collect()) == place(many)


def test_chat_tree_of_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(ODD, TURNS)
    assert {r[0]: tuple(r)[1:] for r in chattree.format_report(odd).collect()} == plain_digests(ODD)
    assert chattree.format_report(spark.createDataFrame([], TURNS)).collect() == []


def test_template_escapes_every_control_string():
    t = chattree.Template()
    rng = random.Random(3)
    parts = [*t.controls, "\\", "<", "[", "/s>", "INST]", "x", "s>"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        got = t.escaped(text)
        assert t.plain(got) == text and not any(m in got for m in t.controls)
    with pytest.raises(ValueError):
        chattree.Template(more=("<<s>",))
    with pytest.raises(ValueError):
        chattree.Template(roles=(("user", "", "[/INST]"), ("assistant", "", "</s>")))


# 12 spelling variants

def plain_variants(words, factor=5):
    same, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1:]
            same[i, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in same.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    form = {}
    for w in words:
        if near[w]:
            b = min(near[w], key=lambda x: (-words[x], x))
            if words[b] >= factor * words[w]:
                form[w] = b
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("letters,n,most", [("ab", 300, 9), ("abcé", 400, 7), ("a", 12, 14), ("aÿ\U00010400", 200, 6)])
def test_variants_equal_brute_force(spark, letters, n, most):
    rng = random.Random(n)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, most))): rng.choice([1, 2, 5, 10, 25, 30, 130, 650, 4000])
             for _ in range(n)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_variants(words)
    for limit in (variants.LIMIT, 3):  # with split partitions as well
        assert {r[0]: tuple(r)[1:] for r in variants.variants(df, limit=limit).collect()} == want
    pairs = variants.near_pairs(df, 5).select("a", "b").collect()
    assert len({frozenset(p) for p in pairs}) == len(pairs) == sum(v[3] for v in want.values()) // 2


def test_acceptor_is_minimal_and_shares_ends():
    a = variants.Acceptor()
    for w in sorted(["tops", "taps", "top", "tap", "stop", "stops"]):
        a.add(list(w))
    a.done()
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += a.next[s].values()
    assert len(reached) == 7  # the beginning, t, ta = to = sto, .p, .ps, s, st
    assert a.words[a.next[0]["t"]] == 4 and a.next[a.next[0]["t"]]["a"] == a.next[a.next[a.next[0]["s"]]["t"]]["o"]


def test_words_are_counted_with_their_corruptions(spark):
    docs = [(i, f"The Quick-brown {'gardens' * (i % 3)} ÀÉÿ×÷abc éCOLE {'x' * (i % 9)}") for i in range(400)]
    want = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = {r.word: r.n for r in variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and len(got) > 5


def test_variants_of_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, word string, n string, half int"
    long = "ab" * 150_000
    rows = [(None, None, "w", "n", 1), (1, "", "w", "n", 1)] + [(None, f"{long} {long}c aaaaaa", "w", "n", 1)] * 5
    rows += [(2, "aaaaab " * 30, "w", "n", 1)]
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in variants.spelling_report(spark.createDataFrame(rows, schema)).collect()}
    assert got == {long: (None, long, 5, 1), long + "c": (None, long + "c", 5, 1), "aaaaaa": ("aaaaab", "aaaaab", 5, 1),
                   "aaaaab": (None, "aaaaab", 30, 1)}
    assert variants.spelling_report(spark.createDataFrame([], schema)).collect() == []


# 13 prefix trie

def plain_trie(rows, rebuild=True):
    seqs = ordered([r for r in rows if r[0] is not None], lambda x: hashlib.md5(x.encode()).hexdigest())
    built = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(seqs.get(base, [])[:h] + own[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(set), Counter(), Counter()
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[:d - 1]].add(p[:d])
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   sha(",".join(map(str, sorted(c for c in m if built[c] == p))))) for p, m in members.items())


def nodes(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


@pytest.mark.parametrize("block", [3, 4096])
def test_trie_equals_brute_force(talks, block):
    paths = prefixtrie.paths(talks)
    rows = talks.collect()
    assert nodes(prefixtrie.trie(prefixtrie.rebuilt(paths), block)) == plain_trie(rows)
    assert nodes(prefixtrie.trie(paths, block)) == plain_trie(rows, rebuild=False)


def test_trie_of_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(ODD, TURNS)
    for block in (1, 100):
        assert nodes(prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.paths(odd)), block)) == plain_trie(ODD)
    empty = spark.createDataFrame([], TURNS)
    assert nodes(prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.paths(empty)))) == []
    # conversations that lose all their turns: the root alone
    short = [(c, 0, "user", "x") for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6]
    got = nodes(prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.paths(
        spark.createDataFrame(short, "conv_id long, turn long, role string, text string"))), 4))
    assert got == plain_trie(short) and len(got) == 1 and got[0][5] == 1


def test_range_minima_and_searches():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 65):
        v = rng.integers(-1, 5, n)
        t = prefixtrie.RangeMin(v)
        for at in range(n):
            for least in range(-1, 7):
                right = next((j for j in range(at, n) if v[j] < least), n)
                left = next((j for j in range(at, -1, -1) if v[j] < least), -1)
                assert t.right(np.array([at]), np.array([least]))[0] == right
                assert t.left(np.array([at]), np.array([least]))[0] == left
            hi = int(rng.integers(at + 1, n + 1))
            assert t.of(np.array([at]), np.array([hi]))[0] == v[at:hi].min()


def test_long_paths_share_prefixes_over_blocks(spark):
    rows = [(c, t, "user", f"{t}" if t < 600 - c else f"{c}.{t}") for c in range(0, 60, 3) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6, F.rand(1))
    assert nodes(prefixtrie.trie(prefixtrie.paths(df), 3)) == plain_trie(rows, rebuild=False)
