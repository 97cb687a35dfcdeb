r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, one turn after another:

    ### <role>:\n<text></turn>\n

with control strings escaped.  In a text a backslash becomes two, every '#' of a run of three or more gets a backslash
before it, and so does the '<' of '</turn>'.  In a role a backslash, a colon and a line end get one, the line end as \n.
To read back, a backslash is dropped and what follows is kept, so every text and role comes back as it was.

The rendering is encoded once, with offsets.  Turn spans (the assistant texts, between their marks) are sorted, and so
are the tokens' spans; a binary search finds the tokens of each turn, and a token is under the loss for the part
of it that lies inside, which is exact where a token runs over a mark too.  The digests are taken from this output:
texts from the rendering cut at its marks, loss text from the masked parts of tokens.

Rows come together by conversation with one shuffle and are sorted inside the task, which streams: it holds one
conversation and a bounded batch of rendered ones.

Defined cases: turns are ordered by turn (null first), ties by role and text; null texts and roles are empty; rows with
null conv_id form one conversation; repeated rows are turns each; other columns are ignored; an empty table gives
an empty result; a conversation without assistant texts has loss length 0.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAME = "op4_chat_formatting"

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
HEAD, END = "### ", "</turn>\n"
#: Characters of rendered conversations that are encoded in one call.
BATCH_CHARS = 1 << 20

_TEXT = re.compile(r"\\|#{3,}|</turn>")
_ROLE = re.compile(r"[\\:\n]")
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: "\\\\" if m[0] == "\\" else "\\#" * len(m[0]) if m[0][0] == "#" else "\\" + m[0], text)


def escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of the turns to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape_role(role)}:\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def _slashes(text: str, end: int) -> int:
    at = end
    while at > 0 and text[at - 1] == "\\":
        at -= 1
    return end - at


def read_turns(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    out, at = [], 0
    while at < len(rendered):
        end = rendered.find(END, at)
        while _slashes(rendered, end) % 2:  # an escaped mark is a part of the text
            end = rendered.find(END, end + 1)
        colon = at + len(HEAD)
        while rendered[colon] != ":":
            colon += 2 if rendered[colon] == "\\" else 1
        out.append((unescape_role(rendered[at + len(HEAD) : colon]), unescape(rendered[colon + 2 : end])))
        at = end + len(END)
    return out


def whole(offsets: list[tuple[int, int]], size: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the tokens' spans, where white space that a tokenizer leaves out of them belongs to the next token (at the end to the last)."""
    starts, ends, done = [], [], 0
    for a, b in offsets:
        starts.append(min(a, done) if a >= done else a)
        done = max(done, b)
        ends.append(done)
    if ends:
        ends[-1] = size
    return starts, ends


def masked(offsets: list[tuple[int, int]], spans: list[tuple[int, int]], size: int) -> list[tuple[int, int, int, int]]:
    """(token, from, to, span) for each token with characters inside a span: the characters it has there.

    Tokens that share a character (parts of one code point) are all under the loss, and the first of them has the
    character; the others have from = to.
    """
    starts, ends = whole(offsets, size)
    out = []
    for n, (low, high) in enumerate(spans):
        done = low
        for i in range(bisect.bisect_right(ends, low), bisect.bisect_left(starts, high)):
            a, b = max(done, starts[i]), min(high, ends[i])
            out.append((i, min(a, b), b, n))
            done = max(done, b)
    return out


def loss_texts(rendered: str, parts: list[tuple[int, int, int, int]], n_spans: int) -> list[str]:
    """The text under the mask, turn by turn, unescaped."""
    out = [[] for _ in range(n_spans)]
    for _, a, b, n in parts:
        out[n].append(rendered[a:b])
    return [unescape("".join(x)) for x in out]


def grouped(rows: DataFrame) -> DataFrame:
    """conv_id, role, text sorted by conversation and turn, each conversation in one partition."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row a conversation: conv_id, n_turns, rendered, token_ids, loss_mask (1 for a token under the loss), loss_from and loss_to (the characters it has there), and the digests read back from them.

    tokenizer: a file that the driver or all machines can read; Spark sends it to the executors.
    """
    sc = rows.sparkSession.sparkContext
    sc.addFile(tokenizer)
    name = tokenizer.rstrip("/").rsplit("/", 1)[-1]
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(SparkFiles.get(name))
        encoder.encode_special_tokens = True
        id_type = None

        def out(waiting):
            encodings = encoder.encode_batch([x[1] for x in waiting], add_special_tokens=False)
            columns: list[list] = [[] for _ in range(10)]
            for (conv_id, rendered, spans, n_turns), e in zip(waiting, encodings, strict=True):
                parts = masked(e.offsets, spans, len(rendered))
                mask = np.zeros(len(e.ids), dtype=np.int32)
                low = np.zeros(len(e.ids), dtype=np.int32)
                high = np.zeros(len(e.ids), dtype=np.int32)
                for i, a, b, _ in parts:
                    if not mask[i]:
                        low[i] = a
                    mask[i], high[i] = 1, b
                learned = "".join(loss_texts(rendered, parts, len(spans)))
                turns = read_turns(rendered)
                if len(turns) != n_turns:
                    raise ValueError("a rendered conversation doesn't read back")
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                values = (conv_id, len(turns), rendered, e.ids, mask, low, high, hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = [id_type, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.string()]
            names = ["conv_id", "n_turns", "rendered", "token_ids", "loss_mask", "loss_from", "loss_to", "turns_sha256", "loss_chars", "loss_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        waiting: list = []
        held = 0
        turns: list[tuple[str, str]] = []
        last: object = None
        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv_id, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if turns and conv_id != last:
                    waiting.append((last, *render(turns), len(turns)))
                    held += len(waiting[-1][1])
                    turns = []
                    if held >= BATCH_CHARS:
                        yield out(waiting)
                        waiting, held = [], 0
                last = conv_id
                turns.append((role, text))
        if turns:
            waiting.append((last, *render(turns), len(turns)))
        if waiting:
            yield out(waiting)

    schema = f"conv_id {kind}, n_turns long, rendered string, token_ids array<int>, loss_mask array<int>, loss_from array<int>, loss_to array<int>, turns_sha256 string, loss_chars long, loss_sha256 string"
    return grouped(rows).mapInArrow(run, schema)


EXTRA = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], rows.schema)
    return formatted(rows.unionByName(extra)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", F.length("rendered").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(text) + length(text) - length(replace(text, '\', '')) + length(array_to_string(regexp_extract_all(text, '#{3,}'), ''))
  + (length(text) - length(replace(text, '</turn>', ''))) // 7 as text_chars,
  length(role) + length(role) - length(regexp_replace(role, '[\\:\n]', '', 'g')) as role_chars from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + role_chars + 2 + text_chars + 8) as bigint) as formatted_chars
from e group by conv_id
"""
