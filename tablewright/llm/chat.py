"""Chat formatting by assembling tokens.

A turn becomes ``TURN role TEXT text END``: role and text are encoded apart from each other, and
the reserved ids between them are spliced in, so no text can ever yield a reserved id. The loss
mask is the running sum of +1 before and -1 after each text of the assistant. Control strings
inside texts and roles get a backslash after their first character (one more, if some are
there already), which takes their effect away for other tools and can be undone exactly.

Turns are encoded where they lie, so a conversation that holds a third of all rows costs one
task no more than others. Only its digest must follow the turns in order: turns are sorted within
partitions and hashed as they stream by, and no conversation is ever held in memory.

Null texts and roles are empty. A null conversation id is a conversation of its own. Turns go
by number (nulls first), then role, then text; repeated rows are repeated turns. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import strings

#: Reserved ids count on from the vocabulary's size; what they look like in text.
MARKS = ["<|turn|>", "<|text|>", "<|end|>"]
TURN, TEXT, END = range(3)
#: Strings with an effect in common templates.
CONTROLS = [*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|startoftext|>"]
_ANY = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN, _ESCAPED = re.compile(_ANY), re.compile(_ANY.replace("\\\\*", "\\\\+"))
LEARNED = "assistant"

FORMATTED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType()))])


def escape(text: str) -> str:
    """``text`` without any control string."""
    return _PLAIN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[0][0]}{m[0][2:]}", text)


@lru_cache(2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def assemble(roles: list[str], texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all turns, loss mask, offset of each turn): segments encoded apart, marks spliced in."""
    t = tokenizer(path)
    base = t.get_vocab_size()
    segments = [e.ids for e in t.encode_batch([escape(s) for pair in zip(roles, texts, strict=True) for s in pair], add_special_tokens=False)]
    sizes = np.array([len(s) for s in segments], np.int64).reshape(-1, 2)
    lengths = sizes.sum(1) + 3
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.full(int(offsets[-1]), -1, np.int32)
    ids[offsets[:-1]] = base + TURN
    ids[offsets[:-1] + 1 + sizes[:, 0]] = base + TEXT
    ids[offsets[1:] - 1] = base + END
    ids[ids < 0] = np.concatenate([np.array(s, np.int32) for s in segments]) if segments else ids[:0]
    learned = np.array([r == LEARNED for r in roles], bool)
    change = np.zeros(ids.size + 1, np.int32)
    np.add.at(change, (offsets[:-1] + 2 + sizes[:, 0])[learned], 1)
    np.add.at(change, (offsets[1:] - 1)[learned], -1)
    return ids, np.cumsum(change)[:-1].astype(np.int32), offsets


def format_turns(df: DataFrame, path: str) -> DataFrame:
    """Token ids and loss mask of each row (conv_id, turn, role, text); one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = strings(batch.column(2)).to_pylist(), strings(batch.column(3)).to_pylist()
            ids, mask, offsets = assemble(roles, texts, path)
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids, mask))], names=FORMATTED.names)

    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, FORMATTED)


BACK = "conv_id long, turn long, role string, text string, learned string, formatted_chars long"


def read_back(df: DataFrame, path: str) -> DataFrame:
    """Formatted turns as texts again: role, text, text under the loss mask, length as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        base = t.get_vocab_size()
        for batch in batches:
            rows = [np.array(x, np.int64) for x in batch.column(2).to_pylist()]
            masks = [np.array(x, np.int64) for x in batch.column(3).to_pylist()]
            segments: list[list[int]] = []
            for ids, mask in zip(rows, masks, strict=True):
                marks = np.flatnonzero(ids >= base)
                if [int(x) - base for x in ids[marks]] != [TURN, TEXT, END] or marks[0] != 0 or marks[2] != ids.size - 1:
                    raise ValueError("a turn does not have the form TURN role TEXT text END")
                segments += [ids[1 : marks[1]].tolist(), ids[marks[1] + 1 : -1].tolist(), ids[mask > 0].tolist()]
            shown = t.decode_batch(segments, skip_special_tokens=False) if segments else []
            size = [len(a) + len(b) + sum(map(len, MARKS)) for a, b in zip(shown[::3], shown[1::3], strict=True)]
            plain = [unescape(s) for s in shown]
            texts = [pa.array(plain[k::3], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *texts, pa.array(size, pa.int64())], names=["conv_id", "turn", "role", "text", "learned", "formatted_chars"])

    return df.mapInArrow(run, BACK)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation from turns that were read back, hashed in order as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DIGEST.split(", ")]
        now: list | None = None  # id, turns, digest, learned characters, their digest, characters

        def closed(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*[[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows], strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for conv, role, text, learned, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learned", "formatted_chars")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += chars
            if done:
                yield closed(done)
        if now is not None:
            yield closed([now])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, DIGEST)
