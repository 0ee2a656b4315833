"""Streaming extraction: HTML chunks in, hash-chained commits of closed blocks out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.htmltree import Tree

COMMIT = "doc_id string, seq bigint, path string, tag string, text string, sha256 string, markdown string, entry_hash string"
STATE = "text string, seq bigint, hash string, next int"


def commits(tree: Tree, start: int, seq: int, before: str) -> tuple[list[tuple], int, str]:
    """Commits of the tree's closed blocks from number `start` on, chained after `before`."""
    out = []
    for node in tree.closed[start:]:
        text = tree.text(node)
        if not text:
            continue
        seq += 1
        sha = hashlib.sha256(text.encode()).hexdigest()
        core = {"seq": seq, "path": tree.path[node], "tag": tree.tag[node], "sha256": sha}
        before = hashlib.sha256((before + json.dumps(core, sort_keys=True)).encode()).hexdigest()
        out.append((seq, tree.path[node], tree.tag[node], text, sha, tree.markdown(node), before))
    return out, seq, before


class Extractor:
    """One document's chunks, in order.  Blocks without an end tag of their own are never committed."""

    def __init__(self) -> None:
        self.tree, self.done, self.seq, self.root_hash, self.ledger = Tree(), 0, 0, "", []

    def feed(self, chunk: str) -> list[tuple]:
        self.tree.feed(chunk)
        return self._drain()

    def close(self) -> list[tuple]:
        self.tree.close()
        return self._drain()

    def pending(self) -> list[str]:
        return [self.tree.tag[n] for n in self.tree.open[1:]]

    def _drain(self) -> list[tuple]:
        new, self.seq, self.root_hash = commits(self.tree, self.done, self.seq, self.root_hash)
        self.done = len(self.tree.closed)
        self.ledger += new
        return new


def verify(ledger: list[tuple], root_hash: str) -> bool:
    before = ""
    for seq, path, tag, text, sha, _, entry in ledger:
        core = {"seq": seq, "path": path, "tag": tag, "sha256": sha}
        before = hashlib.sha256((before + json.dumps(core, sort_keys=True)).encode()).hexdigest()
        if before != entry or hashlib.sha256(text.encode()).hexdigest() != sha:
            return False
    return before == root_hash


def batch_commits(chunks: DataFrame) -> DataFrame:
    """The batch twin, from (doc_id, seq, chunk): where chunks are cut does not matter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = Extractor()
        for chunk in pdf.sort_values("seq")["chunk"]:
            x.feed(chunk)
        x.close()
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *c) for c in x.ledger], columns=[c.split()[0] for c in COMMIT.split(", ")])

    return chunks.groupBy("doc_id").applyInPandas(run, COMMIT)


def stream_commits(chunks: DataFrame) -> DataFrame:
    """A streaming DataFrame of (doc_id, seq, chunk, last) to commits as blocks close.

    State of a document: its text so far and where its chain stands.  A parser's buffers cannot be kept across
    micro-batches, so the text is parsed again, which gives the same closed blocks; only new ones are emitted.  State is
    bounded by the document and dropped at its last chunk.  Chunks of a micro-batch are put in order by seq; one that
    comes before its predecessor waits for it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, seq, before, wanted = state.get if state.exists else ("", 0, "", 0)
        waiting = json.loads(text[1:].split("\x00", 1)[0]) if text.startswith("\x01") else {}
        text = text.split("\x00", 1)[1] if text.startswith("\x01") else text
        closed_before = Tree()
        closed_before.feed(text)
        last = False
        for pdf in frames:
            for row in pdf.itertuples():
                waiting[str(row.seq)] = [row.chunk, bool(row.last)]
        while str(wanted) in waiting:
            chunk, last = waiting.pop(str(wanted))
            text, wanted = text + chunk, wanted + 1
        tree = Tree()
        tree.feed(text)
        if last:
            tree.close()
        new, seq, before = commits(tree, len(closed_before.closed), seq, before)
        if last:
            state.remove()
        else:
            state.update((("\x01" + json.dumps(waiting) + "\x00" + text) if waiting else text, seq, before, wanted))
        yield pd.DataFrame([(key[0], *c) for c in new], columns=[c.split()[0] for c in COMMIT.split(", ")])

    return chunks.groupBy("doc_id").applyInPandasWithState(run, COMMIT, STATE, "append", GroupStateTimeout.NoTimeout)
