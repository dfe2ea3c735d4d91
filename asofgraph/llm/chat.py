"""Chat formatting by columnar byte assembly.

Each batch of turns becomes one preallocated byte buffer: the lengths of all segments (header,
role, content pieces, trailer) give cumulative offsets, the offsets give scatter indices, and one
indexed copy each moves headers and contents into place.

Template, per turn: ``<s>role[INST]\\ntext</s>\\n``. Control strings inside roles and texts are escaped by
one backslash after their first character; runs of backslashes already there grow by one, so
that removing one backslash from every such run restores the text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm.common import pieces

OPEN, BREAK, CLOSE = b"<s>", b"[INST]\n", b"</s>\n"
#: The control strings that no text may spell, without their first character.
CONTROL_TAILS = rb"(?:/?s>|<SYS>>|</SYS>>|/?INST\])"
_TO_ESCAPE = re.compile(rb"(?=([<\[]\\*" + CONTROL_TAILS + rb"))")
_TO_UNESCAPE = re.compile(rb"([<\[])\\(?=\\*" + CONTROL_TAILS + rb")")
_TURN = re.compile(rb"<s>(.*?)\[INST\]\n(.*?)</s>\n", re.DOTALL)
TRAINED_ROLE = "assistant"

_OUT = "conv_id long, chunk long, n_turns long, formatted binary, loss_start array<long>, loss_bytes array<long>"


def escape(data: bytes) -> bytes:
    cuts = [m.start() + 1 for m in _TO_ESCAPE.finditer(data)]
    return b"\\".join(data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True))


def unescape(data: bytes) -> bytes:
    return _TO_UNESCAPE.sub(rb"\1", data)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls empty, and its n + 1 offsets from 0."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _insertions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions before which a backslash goes, none for a control string across two rows."""
    found = [(m.start(1), m.end(1)) for m in _TO_ESCAPE.finditer(data.tobytes())]
    if not found:
        return np.empty(0, np.int64)
    start, end = np.array(found, np.int64).T
    row = np.searchsorted(offsets, start, "right")
    return start[row == np.searchsorted(offsets, end - 1, "right")] + 1


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> None:
    """Copy row i of ``data`` to out[at[i]:], a backslash before every position in ``cuts``."""
    lengths = np.diff(offsets)
    if len(lengths) == 1:  # one row, however long, needs no index for each byte
        edges = [0, *cuts.tolist(), len(data)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            to = int(at[0]) + a + k
            out[to:to + b - a] = data[a:b]
            out[to - 1:to] = ord("\\") if k else out[to - 1:to]
        return
    place = np.repeat(at - offsets[:-1], lengths) + np.arange(len(data))
    if len(cuts):
        before = np.searchsorted(cuts, np.arange(len(data)), "right")
        first = np.searchsorted(cuts, offsets[:-1], "right")
        place += before - np.repeat(first, lengths)
        out[place[cuts] - 1] = ord("\\")
    out[place] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, n + 1 turn offsets, content starts, content lengths) of formatted turns."""
    role, role_at = _utf8(roles)
    text, text_at = _utf8(texts)
    role_cuts, text_cuts = _insertions(role, role_at), _insertions(text, text_at)
    grown = [np.bincount(np.searchsorted(at, cuts - 1, "right") - 1, minlength=len(at) - 1) for cuts, at in ((role_cuts, role_at), (text_cuts, text_at))]
    role_len, text_len = np.diff(role_at) + grown[0], np.diff(text_at) + grown[1]
    total = len(OPEN) + role_len + len(BREAK) + text_len + len(CLOSE)
    ends = np.concatenate(([0], np.cumsum(total)))
    starts, out = ends[:-1], np.empty(ends[-1], np.uint8)
    content = starts + len(OPEN) + role_len + len(BREAK)
    for header, at in ((OPEN, starts), (BREAK, content - len(BREAK)), (CLOSE, content + text_len)):
        out[at[:, None] + np.arange(len(header))] = np.frombuffer(header, np.uint8)
    _scatter(out, starts + len(OPEN), role, role_at, role_cuts)
    _scatter(out, content, text, text_at, text_cuts)
    return out, ends, content, text_len


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in pieces(batches, "text"):
        role = batch["role"].fill_null("")
        out, ends, content, length = assemble(role, batch["text"])
        ids = batch["conv_id"].cast(pa.int64())
        key = ids.fill_null(0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1]))))
        stops = np.append(new[1:], batch.num_rows)
        trained = role.to_numpy(zero_copy_only=False) == TRAINED_ROLE
        below = np.concatenate(([0], np.cumsum(trained)))
        owner = np.repeat(np.arange(len(new)), stops - new)
        relative = (content - ends[:-1][new][owner])[trained]
        lists = pa.array(below[np.append(new, batch.num_rows)].astype(np.int32))
        offsets = pa.array(ends[np.append(new, batch.num_rows)]).cast(pa.int64())
        formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, offsets.buffers()[1], pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(new)),
                pa.array(chunk + np.arange(len(new))),
                pa.array(stops - new),
                formatted.cast(pa.binary()),
                pa.ListArray.from_arrays(lists, pa.array(relative)),
                pa.ListArray.from_arrays(lists, pa.array(length[trained])),
            ],
            names=["conv_id", "chunk", "n_turns", "formatted", "loss_start", "loss_bytes"],
        )
        chunk += len(new)


def format_conversations(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Formatted conversations as ordered chunks with the byte spans under the loss mask.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. Rows are ordered by
    turn (null first), ties by role and text; repeated rows stay. Null texts and roles are empty;
    a null conv_id is a conversation of its own. An empty table gives no chunk. Rows are dealt by
    ranges of (conv_id, turn), so one conversation with a third of all rows spreads over many
    tasks; its chunks in order of ``chunk`` are its whole text. Returns conv_id, chunk, n_turns,
    formatted (UTF-8), loss_start and loss_bytes (spans of trained contents in the chunk).
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*keys)
    count = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(count, *keys).sortWithinPartitions(*keys).mapInArrow(_format_batches, _OUT)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _code_points(data: bytes) -> int:
    return len(data.decode("utf-8"))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, turns, loss, counts, done = (), None, None, [], []

    def close() -> None:
        done.append((current[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [c.split()[0] for c in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        columns = [batch[n].to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_bytes")]
        for conv, data, starts, lengths in zip(*columns, strict=True):
            if current != (conv,):
                if current:
                    close()
                current, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            for turn in _TURN.finditer(data):
                turns.update(unescape(turn[1]) + b"\n" + unescape(turn[2]) + b"\n")
                counts[0] += 1
            for start, length in zip(starts, lengths, strict=True):
                text = unescape(data[start:start + length])
                loss.update(text)
                counts[1] += _code_points(text)
            counts[2] += _code_points(data)
        if len(done) >= 4096:
            yield flush()
            done.clear()
    if current:
        close()
    yield flush()


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted chunks alone.

    One digest over a conversation is sequential, so the chunks of a conversation (at most one an
    Arrow batch, not one a turn) pass in order through one task, which holds one chunk at a time.
    """
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_read_batches, _READ)


#: The conversation that the query adds: its texts spell control strings. Fixed by contract.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.withColumn("text", F.coalesce("text", F.lit(""))).union(probe)))


#: Formatted length: the contract's only template-dependent figure; 15 markup characters a turn, its role, and one escape for each control string.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + length(role) + 15
    + length(regexp_replace(text, '([<\[]\\*)((?:/?s>|<SYS>>|</SYS>>|/?INST\]))', '\1\\\2', 'g')) - length(text)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
