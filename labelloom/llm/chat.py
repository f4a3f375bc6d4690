"""Chat formatting with a prefix tree.

Conversations are ordered by the hashes of their turns, so those that share initial turns are neighbours and an ordered
scan meets the tree depth first. A range partition cuts the order anywhere, also within one very common first turn; each
task packs its part into sequences. In a sequence every shared turn is written once; a turn has the position of its first
token on the path from its root, and the intervals of the sequence that its ancestors occupy, which together with what
precedes it in the turn are all that its tokens may attend to. Tokens are code points here.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import shared

#: Tokens after which a sequence is closed. A conversation that is longer has a sequence of its own.
SEQUENCE_TOKENS = 32_768
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]"]
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"\[INST\] ((?:\\.|(?!\[/INST\])[^\\])*) \[/INST\]|<s>((?:\\.|(?!</s>)[^\\])*)</s>|\[ROLE\]((?:\\.|(?!\[TEXT\])[^\\])*)\[TEXT\]((?:\\.|(?!\[/ROLE\])[^\\])*)\[/ROLE\]", re.S)


def escape(text: str) -> str:
    """Backslashes doubled, and one put before every control string."""
    return CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(the formatted turn, start and end of its loss mask)."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    return f"[ROLE]{escape(role)}[TEXT]{body}[/ROLE]", 0, 0


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m[1] is not None:
            out.append(("user", unescape(m[1])))
        elif m[2] is not None:
            out.append(("assistant", unescape(m[2])))
        else:
            out.append((unescape(m[3]), unescape(m[4])))
    return out


NODES = "array<struct<start:int,end:int,parent:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>"
SEQUENCES = f"text string, nodes {NODES}, leaves array<struct<conv_id:bigint,node:int>>"


class Packer:
    """Grows one sequence, conversation by conversation in depth-first order."""

    def __init__(self):
        self.parts, self.size, self.nodes, self.leaves = [], 0, [], []
        self.path: list[tuple[tuple[str, str], int]] = []

    def shared_with(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < len(turns) and n < len(self.path) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], rendered: list[tuple[str, int, int]], same: int) -> None:
        del self.path[same:]
        for turn, (text, a, b) in zip(turns[same:], rendered[same:]):
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            attends = []
            if above:
                attends = list(above["attends"])
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1] = {"start": attends[-1]["start"], "end": above["end"]}
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            self.path.append((turn, len(self.nodes)))
            self.nodes.append({"start": self.size, "end": self.size + len(text), "parent": parent, "position": above["position"] + above["end"] - above["start"] if above else 0,
                               "loss_start": self.size + a, "loss_end": self.size + b, "attends": attends})
            self.parts.append(text)
            self.size += len(text)
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


SCHEMA = pa.schema([("text", pa.string()),
                    ("nodes", pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "parent", "position", "loss_start", "loss_end")] + [("attends", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))),
                    ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])


def sequences(turns: DataFrame, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """The packed sequences of (conv_id, turn, role, text), stored in the shared folder.

    Turns are ordered by ``turn`` (null first), then role and text; a null role or text counts as empty. Rows without a
    conv_id are one conversation. Repeated rows are turns of their own. Other columns are ignored. An empty table has no
    sequences.
    """
    spark = turns.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t.role, t.text)))
    n_bytes = turns.select(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    ordered = whole.repartitionByRange(shared.partitions(spark, n_bytes), "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches):
        pack, out, size = Packer(), [], 0
        for b in batches:
            for conv_id, listed in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
                turns = [(t["role"], t["text"]) for t in listed]
                rendered = [render(*t) for t in turns]
                same = pack.shared_with(turns)
                if pack.leaves and pack.size + sum(len(r[0]) for r in rendered[same:]) > limit:
                    out.append(pack.row())
                    size += pack.size
                    pack, same = Packer(), 0
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, SCHEMA)
                        out, size = [], 0
                pack.add(conv_id, turns, rendered, same)
        if pack.leaves:
            out.append(pack.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return shared.materialise(ordered.select("conv_id", "turns").mapInArrow(run, SEQUENCES))


def read_back(packed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the sequences alone."""
    def run(batches):
        for b in batches:
            out = []
            for text, nodes, leaves in zip(*(b.column(c).to_pylist() for c in ("text", "nodes", "leaves"))):
                turns = [read(text[n["start"]:n["end"]])[0] for n in nodes]
                loss = [unescape(text[n["loss_start"]:n["loss_end"]]) for n in nodes]
                for leaf in leaves:
                    path, k = [], leaf["node"]
                    while k >= 0:
                        path.append(k)
                        k = nodes[k]["parent"]
                    path.reverse()
                    said = hashlib.sha256()
                    for k in path:
                        said.update(f"{turns[k][0]}\n{turns[k][1]}\n".encode("utf-8", "surrogatepass"))
                    under = "".join([loss[k] for k in path])
                    out.append((leaf["conv_id"], len(path), said.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), sum(nodes[k]["end"] - nodes[k]["start"] for k in path)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    return packed.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def formatted(turns: DataFrame) -> DataFrame:
    """``read_back`` of the sequences of the given turns."""
    return read_back(sequences(turns))
