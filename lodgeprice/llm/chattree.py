"""Chat formatting over a prefix tree: shared turns are emitted once, depth first, with attention intervals.

Every conversation is a path of turns (ordered by turn, nulls first; role; text).
A turn is formatted by a template: markers around the text, each one token of its
own; control strings inside a text or a role are escaped and can be read back.
Conversations that begin with the same turns share these turns' tokens.

1. One pass formats and tokenises each conversation and keeps per turn a digest and
   the number of tokens.
2. Digests alone are sorted by (path, conv_id): that is the depth-first order of the
   tree, and copies of one conversation are dealt over partitions by their id. Along
   a sorted partition each row emits the tokens behind what it shares with the row
   before; all others it finds in intervals that earlier rows emitted. The first row
   of a partition is treated as if nothing came before; the edges of the partitions
   (two paths each, on the driver) then give every partition the part of its first
   row that was emitted before, and its place in the whole order.
3. Each conversation's own tokens are cut out and numbered.

A row is one conversation: its tree (numbered by its first token), ``start`` in the
tree's sequence, its own ``tokens`` with ``position_ids`` (counted along the path,
ancestors included) and ``loss_mask`` (assistant texts), and ``attends``, the
intervals of the tree's sequence that hold its ancestors' tokens, in order: a token
attends to these and, causally, to the row's own. Rows without own tokens are copies
or beginnings of others.

Defined cases: null texts and roles are empty; rows with a null ``conv_id`` are one
conversation; repeated rows and turns are turns of their own; long texts are whole
(runs of over ``PIECE`` code points without a change between blank and non-blank are
tokenised in pieces); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: A public byte-level vocabulary as tiktoken ranks; any other file of that form will do.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to it (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The ranks are read by the driver and sent to all tasks: a larger file is refused.
MOST_BYTES = 64 << 20
PIECE = 1000


@dataclass(frozen=True)
class Template:
    """Markers per role, (before, after); other roles are written out between ``other[0]`` and ``other[1]``.

    Every control string begins with a sign of ``openers`` that occurs nowhere else in one, so that neither two
    of them nor a text and a marker can overlap. A control string in a text gets ``escape`` behind its first sign;
    one that has some already gets one more.
    """

    roles: tuple = (("user", "[INST]", "[/INST]"), ("system", "[SYS]", "[/SYS]"), ("assistant", "", "</s>"))
    other: tuple = ("[ROLE]", "[/ROLE]", "</s>")
    more: tuple = ("<s>",)
    learn: tuple = ("assistant",)
    openers: str = "<["
    escape: str = "\\"
    controls: tuple = field(init=False)

    def __post_init__(self):
        marks = [m for _, a, b in self.roles for m in (a, b)] + [*self.other, *self.more]
        marks = list(dict.fromkeys(m for m in marks if m))
        for m in marks:
            if m[0] not in self.openers or any(o in m[1:] for o in self.openers) or self.escape in m:
                raise ValueError(f"control string {m!r} could overlap with others")
        if len({a for _, a, _ in self.roles} | {self.other[0]}) <= len(self.roles):
            raise ValueError("roles must begin differently")
        object.__setattr__(self, "controls", tuple(marks))

    def _rule(self) -> re.Pattern:
        rests = "|".join(re.escape(m[1:]) for m in sorted(self.controls, key=len, reverse=True))
        return re.compile(f"(?P<o>[{re.escape(self.openers)}])(?P<e>{re.escape(self.escape)}*)(?P<r>{rests})")

    def escaped(self, text: str) -> str:
        return self._rule().sub(lambda m: m["o"] + self.escape + m["e"] + m["r"], text) if text else text

    def plain(self, text: str) -> str:
        return self._rule().sub(lambda m: m["o"] + m["e"][len(self.escape):] + m["r"], text) if text else text

    def turn(self, role: str, text: str) -> list[tuple[str, bool, bool]]:
        """(string, is a marker, is learnt) in order."""
        for name, before, after in self.roles:
            if name == role:
                head = [(before, True, False)] if before else []
                return [*head, (self.escaped(text), False, role in self.learn), (after, True, False)]
        a, b, c = self.other
        return [(a, True, False), (self.escaped(role), False, False), (b, True, False),
                (self.escaped(text), False, role in self.learn), (c, True, False)]


class Codec:
    """Token ids of formatted turns and back; markers have ids of their own behind the vocabulary."""

    def __init__(self, template: Template, ranks: bytes | None):
        self.template = template
        if ranks is None:
            self.bpe, self.base = None, 256
        else:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
            self.bpe = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            self.base = max(table.values()) + 1
        self.ids = {m: self.base + i for i, m in enumerate(template.controls)}
        self.marks = {i: m for m, i in self.ids.items()}
        self.long = re.compile(rf"\S{{{PIECE}}}|\s{{{PIECE}}}")

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.bpe is None:
            return list(text.encode())
        out, lo = [], 0
        for m in self.long.finditer(text):
            out += self.bpe.encode_ordinary(text[lo:m.end()])
            lo = m.end()
        return out + self.bpe.encode_ordinary(text[lo:]) if lo < len(text) else out

    def decode(self, ids: list[int]) -> str:
        return (bytes(ids) if self.bpe is None else self.bpe.decode_bytes(ids)).decode()

    def turn(self, role: str, text: str) -> tuple[list[int], list[bool]]:
        ids, learnt = [], []
        for part, marker, learn in self.template.turn(role, text):
            got = [self.ids[part]] if marker else self.encode(part)
            ids += got
            learnt += [learn] * len(got)
        return ids, learnt

    def read(self, ids: np.ndarray, learnt: np.ndarray):
        """(formatted text, [(role, text)], [learnt texts]) of one conversation's tokens."""
        t = self.template
        close = {after: name for name, _, after in t.roles}
        open_ = {before: name for name, before, _ in t.roles if before}
        silent = next((name for name, before, _ in t.roles if not before), None)
        whole, turns, loss = [], [], []
        role, text, lo = None, "", 0
        for at in [*np.flatnonzero(ids >= self.base).tolist(), None]:
            chunk = slice(lo, at)
            piece = self.decode(ids[chunk].tolist())
            whole.append(piece)
            if learnt[chunk].any():
                loss.append(t.plain(self.decode(ids[chunk][learnt[chunk]].tolist())))
            text += piece
            if at is None:
                break
            mark, lo = self.marks[int(ids[at])], at + 1
            whole.append(mark)
            if mark in open_:
                role, text = open_[mark], ""
            elif mark == t.other[0]:
                role, text = None, ""
            elif mark == t.other[1]:
                role, text = t.plain(text), ""
            elif mark in close or mark == t.other[2]:
                turns.append((silent if role is None else role, t.plain(text)))
                role, text = None, ""
        return "".join(whole), turns, loss


_codecs: dict = {}


def _codec(template: Template, ranks) -> Codec:
    """One codec a worker; ``ranks`` is a broadcast of the file's bytes, or None for plain bytes."""
    key = (template, None if ranks is None else hashlib.sha256(ranks.value).digest())
    if key not in _codecs:
        _codecs[key] = Codec(template, None if ranks is None else ranks.value)
    return _codecs[key]


def load_ranks(spark, path: str | None):
    """The rank file, read once by the driver, as a broadcast."""
    if path is None:
        return None
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} holds more than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


TOKENS = "conv_id long, keys array<binary>, counts array<int>, tokens array<int>, loss array<boolean>"


def tokenised(conversations: DataFrame, template: Template, ranks) -> DataFrame:
    """One row per conversation: digest and number of tokens of each turn, and all its tokens."""
    small_batches(conversations.sparkSession)
    c = conversations
    turn = F.struct(c["turn"].alias("turn"), F.coalesce(c["role"], F.lit("")).alias("role"),
                    F.coalesce(c["text"], F.lit("")).alias("text"))
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("t"))

    def run(batches):
        codec = _codec(template, ranks)
        done, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

        for batch in batches:
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts, ids, learnt = [], [], [], []
                for t in turns.as_py():
                    head = f"{len(t['role'])}:{t['role']}".encode()
                    keys.append(hashlib.md5(head + t["text"].encode()).digest())
                    a, b = codec.turn(t["role"], t["text"])
                    counts.append(len(a))
                    ids += a
                    learnt += b
                done.append((conv, keys, counts, np.array(ids, np.int32), np.array(learnt, bool)))
                size += len(ids)
                if size >= 200_000:
                    yield flush()
                    done, size = [], 0
        if done:
            yield flush()

    names = [x.split()[0] for x in TOKENS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    return rows.mapInArrow(run, TOKENS)


def shared(a: list, b: list) -> int:
    """Turns at the beginning that are the same."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def clip(pieces: list, end: int) -> list:
    """The pieces (from position, to position, segment, offset of the first) up to a position."""
    return [(lo, min(hi, end), seg, at) for lo, hi, seg, at in pieces if lo < end]


PLACE = ("conv_id long, part int, own int, size int, begin long, pieces array<struct<lo:int,hi:int,seg:long,at:long>>, "
         "first_keys array<binary>, first_counts array<int>, last_keys array<binary>, emitted long")


def _placed(batches):
    """Along a sorted partition: what each row emits, and the pieces of its path that earlier rows emitted."""
    from pyspark import TaskContext

    part, emitted, before, pieces, first = TaskContext.get().partitionId(), 0, [], [], None
    held = None
    names = [x.split()[0] for x in PLACE.split(", ")]
    names[5:] = ["pieces", "first_keys", "first_counts", "last_keys", "emitted"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(),
             pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("seg", pa.int64()), ("at", pa.int64())])),
             pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int64()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows = []
        for conv, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            same = shared(before, keys)
            own, size = sum(counts[:same]), sum(counts)
            above = clip(pieces, own)
            row = [conv, part, own, size, emitted,
                   [{"lo": lo, "hi": hi, "seg": seg, "at": at} for lo, hi, seg, at in above],
                   keys if first is None else None, counts if first is None else None, None, None]
            pieces = above + ([(own, size, emitted, emitted)] if size > own else [])
            first, before, emitted = first or True, keys, emitted + size - own
            if held is not None:
                rows.append(held)
            held = row
        if rows:
            yield out(rows)
    if held is not None:
        held[8:] = [before, emitted]
        yield out([held])


class Order:
    """Where each partition's sequence lies in the whole, and the pieces its first row takes from earlier ones."""

    def __init__(self, edges: list):
        self.parts: dict = {}
        at, last_keys, last_pieces, first = 0, [], [], None
        for e in edges:  # by partition; a partition's first row, then its last, which may be the same
            if e["first_keys"] is not None:
                same = shared(last_keys, e["first_keys"])
                taken = sum(e["first_counts"][:same])
                self.parts[e["part"]] = (at - taken, taken, clip(last_pieces, taken))
            if e["last_keys"] is not None:
                last_keys, shift = e["last_keys"], self.parts[e["part"]][0]
                last_pieces = self.pieces(e["part"], e["pieces"])
                own, begin = self.own(e["part"], e["own"], e["size"], e["begin"])
                if e["size"] > own:
                    last_pieces = last_pieces + [(own, e["size"], begin, begin)]
                at = shift + e["emitted"]

    def own(self, part: int, own: int, size: int, begin: int) -> tuple[int, int]:
        """(position of the first own token, its place in the whole order)."""
        shift, taken, _ = self.parts[part]
        if begin == 0 and own == 0:  # the first row of the partition
            return min(taken, size), shift + min(taken, size)
        return own, begin + shift

    def pieces(self, part: int, pieces: list) -> list:
        """Pieces of a path in the whole order."""
        shift, taken, carried = self.parts[part]
        out = []
        for p in pieces:
            lo, hi, seg, at = p["lo"], p["hi"], p["seg"], p["at"]
            if seg == 0:  # emitted by the partition's first row, or before
                out += clip(carried, min(hi, taken))
                if hi > taken:
                    out.append((taken, hi, shift + taken, shift + taken))
            else:
                out.append((lo, hi, seg + shift, at + shift))
        return out


FORMATTED = ("conv_id long, tree long, start long, tokens array<int>, position_ids array<int>, loss_mask array<boolean>, "
             "attends array<struct<segment:long,start:long,end:long>>")


def format_tree(conversations: DataFrame, template: Template = Template(), ranks_path: str | None = RANKS) -> DataFrame:
    """The formatted conversations; see the module's text. ``ranks_path`` None: one token per byte."""
    spark = conversations.sparkSession
    ranks = load_ranks(spark, ranks_path)
    whole = written(tokenised(conversations, template, ranks), "chat-tokens")
    placed = written(whole.select("conv_id", "keys", "counts").orderBy("keys", "conv_id").mapInArrow(_placed, PLACE),
                     "chat-places")
    edges = placed.where("first_keys is not null or last_keys is not null").select(
        "part", "own", "size", "begin", "pieces", "first_keys", "first_counts", "last_keys", "emitted").collect()
    edges.sort(key=lambda e: (e["part"], e["last_keys"] is not None))
    order = spark.sparkContext.broadcast(Order(edges))
    names = [x.split()[0] for x in FORMATTED.split(", ")][:6] + ["attends"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()),
             pa.list_(pa.struct([("segment", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        o = order.value
        for batch in batches:
            rows = []
            tokens, loss = batch.column(6), batch.column(7)
            for i, (conv, part, own, size, begin, pieces) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)))):
                above = o.pieces(part, pieces)
                first = begin == 0 and own == 0
                own, begin = o.own(part, own, size, begin)
                if first:
                    above = clip(o.parts[part][2], own)
                tree = above[0][3] if above else begin
                rows.append((conv, tree, begin - tree, np.asarray(tokens[i].values)[own:], np.arange(own, size, dtype=np.int32),
                             np.asarray(loss[i].values)[own:] if size > own else np.empty(0, bool),
                             [{"segment": s - tree, "start": at - tree, "end": at - tree + hi - lo}
                              for lo, hi, s, at in above]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    p, w = placed.alias("p"), whole.alias("w")
    both = p.join(w, F.col("p.conv_id").eqNullSafe(F.col("w.conv_id"))).select(
        "p.conv_id", "part", "own", "size", "begin", "pieces", "tokens", "loss")
    return both.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, salts: int = 64) -> DataFrame:
    """``conv_id, tokens, loss``: every conversation's whole path, from its intervals and its own tokens.

    Segments that more than one in 256 of all intervals lie in (at most 256 of them) are copied ``salts`` times, and
    their intervals dealt over the copies.
    """
    refs = formatted.select("conv_id", "tree", F.posexplode("attends").alias("k", "a")).select(
        "conv_id", "tree", "k", "a.segment", "a.start", "a.end")
    uses = refs.groupBy("tree", "segment").agg(F.count("*").alias("uses"))
    total = uses.agg(F.sum("uses")).first()[0] or 0
    hot = F.broadcast(uses.where(F.col("uses") > max(total / 256, 1)).select("tree", "segment", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("conv_id"), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    refs = refs.join(hot, ["tree", "segment"], "left").withColumn("salt", salt).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long")))
    segments = formatted.where(F.size("tokens") > 0).select("tree", F.col("start").alias("segment"), "tokens", "loss_mask")
    segments = segments.join(hot, ["tree", "segment"], "left").withColumn("salt", F.explode(copies)).drop("hot")
    parts = refs.join(segments, ["tree", "segment", "salt"])
    cut = [F.slice(c, (F.col("start") - F.col("segment") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias(c)
           for c in ("tokens", "loss_mask")]
    own = formatted.select("conv_id", F.size("attends").alias("k"), "tokens", "loss_mask")
    parts = parts.select("conv_id", "k", *cut).unionByName(own)
    rows = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "tokens", "loss_mask"))).alias("p"))
    return rows.select("conv_id", F.flatten("p.tokens").alias("tokens"), F.flatten("p.loss_mask").alias("loss"))


def digests(formatted: DataFrame, template: Template = Template(), ranks_path: str | None = RANKS) -> DataFrame:
    """Per conversation, read back from the formatted tree: turns, learnt text and length."""
    ranks = load_ranks(formatted.sparkSession, ranks_path)
    small_batches(formatted.sparkSession)

    def run(batches):
        codec = _codec(template, ranks)
        for batch in batches:
            rows = []
            for conv, ids, learnt in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, turns, loss = codec.read(np.asarray(ids.values), np.asarray(learnt.values))
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
                under = "".join(loss)
                rows.append((conv, len(turns), hashlib.sha256(said).hexdigest(), len(under),
                             hashlib.sha256(under.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                    ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read_back(formatted).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_report(conversations: DataFrame, template: Template = Template(), ranks_path: str | None = RANKS) -> DataFrame:
    """The digests of the formatted conversations; the tree is written once."""
    return digests(written(format_tree(conversations, template, ranks_path), "chat-tree"), template, ranks_path)
