"""Secret scans with one combined deterministic automaton over bytes.

All rules' regular expressions become one automaton (subset construction, minimisation,
transition arrays). A batch of documents is scanned in lanes, one byte of each document a step,
so that one pass over the bytes serves every rule; a step reports the rules whose match ended.
A backwards automaton of the rule then finds the leftmost start of that match, no earlier than
the end of the rule's match before it, which gives the leftmost non-overlapping matches. Each
match is finally checked by its length.

Cases: null text counts as empty and has no spans; texts of any length are scanned whole, in
lanes that end at their own length; the matches of different rules may overlap or tie, each
rule is on its own; repeated rows give repeated results; an empty table gives none; only the
named columns are read, and `spans` and `masked` replace input columns of these names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.automaton import Automaton

# Fixed values: (kind, pattern, pattern for the checking group, least length of that group).
# Group 0 is the whole match. The first three kinds are the base.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    ("assign", ASSIGN, 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{8}[0-9a-f]*", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 27),
)
BASE_KINDS = ("assign", "access", "hex")
#: Below so many lanes a plain loop over the rest of each document is quicker than array steps.
FEW_LANES = 48

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.forward = Automaton([p for _, p, _, _ in rules])
        self.back = [Automaton([p], search=False, backwards=True) for _, p, _, _ in rules]
        self.exact = [re.compile(p.encode()) for _, p, _, _ in rules]

    def ends(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each document with any: (end offset in the document, rule bits) in order."""
        f = self.forward
        step, ended, classes, width = f.step, f.ended, f.classes, f.width
        order = np.argsort(-sizes, kind="stable")
        state = np.zeros(len(order), np.int32)
        at = starts[order].astype(np.int64)
        sorted_sizes = sizes[order]
        out: dict[int, list[tuple[int, int]]] = {}
        active, t = int((sorted_sizes > 0).sum()), 0
        ascending = sorted_sizes[::-1]
        while active > FEW_LANES:
            # All lanes here go on to the end of the shortest one.
            stop = int(sorted_sizes[active - 1])
            s, p = state[:active], at[:active]
            for t in range(t, stop):
                i = s + classes[data[p]]
                s = step[i]
                e = ended[i]
                if e.any():
                    for lane in np.flatnonzero(e):
                        out.setdefault(int(order[lane]), []).append((t, int(e[lane])))
                p += 1
            state[:active] = s
            t = stop
            active = len(order) - int(np.searchsorted(ascending, t, side="right"))
        if active:
            step_l, ended_l, classes_l = self._lists()
            for lane in range(active):
                doc, s, a = int(order[lane]), int(state[lane]), int(starts[order[lane]])
                hits = out.get(doc, [])
                for k, c in enumerate(data[a + t : a + int(sorted_sizes[lane])].tobytes(), t):
                    i = s + classes_l[c]
                    s = step_l[i]
                    if ended_l[i]:
                        hits.append((k, ended_l[i]))
                state[lane] = s
                if hits:
                    out[doc] = hits
        last = f.accept[state // width]
        for lane in np.flatnonzero(last):
            out.setdefault(int(order[lane]), []).append((int(sorted_sizes[lane]), int(last[lane])))
        return out

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = self.forward.step.tolist(), self.forward.ended.tolist(), self.forward.classes.tolist()
        return self._as_lists

    def spans(self, doc: bytes, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(byte start, rule, byte end) by start, then rule."""
        found = []
        upto = [0] * len(self.rules)
        for end, bits in ends:
            for r in range(len(self.rules)):
                if bits >> r & 1:
                    start = self.back[r].farthest(doc, end, upto[r])
                    if start < 0:
                        continue
                    upto[r] = end
                    _, _, group, least = self.rules[r]
                    whole = self.exact[r].fullmatch(doc[start:end])
                    if whole and len(whole[group]) >= least:
                        found.append((start, r, end))
        return sorted(found)

    def scan(self, texts: pa.Array) -> list[tuple[list[tuple[int, int, int]], bytes]]:
        """For each text its byte spans and, where it has any, its bytes."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"\0", np.uint8)
        sizes = np.diff(offsets)
        if texts.null_count:
            sizes = np.where(np.asarray(texts.is_null()), 0, sizes)
        out: list = [([], b"")] * len(texts)
        for d, ends in self.ends(data, offsets[:-1], sizes).items():
            doc = data[offsets[d] : offsets[d] + sizes[d]].tobytes()
            out[d] = (self.spans(doc, ends), doc)
        return out


@functools.cache
def scanner() -> Scanner:
    """Compiled once on the driver; its size depends on the rules alone (a few MB)."""
    return Scanner()


def masked(doc: bytes, spans: list[tuple[int, int, int]], mark: bytes = b"[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            if start >= at:
                out += [doc[at:start], mark]
            at = end
    return b"".join([*out, doc[at:]]).decode()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, or one row.

    A part of a batch is copied, so that its arrays begin at their buffers' start: pyarrow's
    ASCII kernels read the wrong bytes of a cast array that does not.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        n, start = len(texts), 0
        sizes = np.asarray(pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())))
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        while start < n:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
            yield batch if stop - start == n else batch.take(pa.array(np.arange(start, stop)))
            # What the slice's arrays took goes back to the machine, not into the pool's reserve.
            pa.default_memory_pool().release_unused()
            start = stop


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mask: bool = False) -> DataFrame:
    """keep and spans (kind, start, end in code points; by start, then kind as listed in RULES).

    With mask=True also `masked`: the text with each secret replaced, null where there is none.
    """
    own = ["spans", *(["masked"] if mask else [])]
    kept = [c for c in keep if c not in own]
    # A text that is kept is not sent twice.
    source = docs.select(*kept, *([] if text in kept else [F.col(text).cast("string").alias("_text")]))
    read = text if text in kept else "_text"
    place = source.columns.index(read)
    fields = [source.schema[c] for c in kept] + [T.StructField("spans", SPANS)] + ([T.StructField("masked", T.StringType())] if mask else [])

    shared = docs.sparkSession.sparkContext.broadcast(scanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        kinds = [r[0] for r in s.rules]
        for batch in slices(batches, read):
            spans, texts = [], []
            for found, doc in s.scan(batch.column(place)):
                if not found:
                    spans.append([])
                    texts.append(None)
                    continue
                # Code points before a byte offset: bytes that are not continuation bytes.
                heads = np.concatenate([[0], np.cumsum((np.frombuffer(doc, np.uint8) & 0xC0) != 0x80)])
                spans.append([{"kind": kinds[r], "start": int(heads[a]), "end": int(heads[b])} for a, r, b in found])
                texts.append(masked(doc, found) if mask else None)
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(spans, ARROW_SPANS)] + ([pa.array(texts, pa.string())] if mask else [])
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def digest(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(*keep, *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
