"""Token counts of sections, from one encoding of the whole document.

A document is encoded once, as it is; the character span of each token is
joined with the spans of the document's sections, so that counts add up to
the document's own.  A token that crosses from one section into others
belongs to the one holding most of its characters, the first of equals
(rule ``majority``), or to the one holding its first character (``first``).
Characters between or after sections belong to section -1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.tokens import ByteEncoder, byte_bpe_path, chunks

RULES = ("majority", "first")
#: What ends a sentence.
STOPS = ".!?"


def sentences(text: str) -> np.ndarray:
    """(n, 2) spans that cover the text: lines, cut after a stop and a space; white space belongs to what it ends."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = code == 10
    ends[1:] |= (code[1:] == 32) & np.isin(code[:-1], [ord(c) for c in STOPS])
    at = np.flatnonzero(ends) + 1
    edges = np.concatenate([[0], at, [len(code)] if not len(at) or at[-1] < len(code) else []]).astype(np.int64)
    return np.column_stack([edges[:-1], edges[1:]])


def token_spans(text: str, ids: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(n, 2) character spans of byte-level tokens; a token of some bytes of a character spans that character."""
    end = np.cumsum(width[ids])
    start = end - width[ids]
    if text.isascii():
        return np.column_stack([start, end])
    char = np.cumsum(np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0 != 0x80) - 1
    return np.column_stack([char[start], char[end - 1] + 1])


def join_spans(tokens: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(section of every token, whether it crosses): ``sections`` disjoint and in order, section -1 for none."""
    # stretches: every section and every gap before, between and after them
    cuts = np.unique(np.concatenate([[0], sections.ravel(), [max(tokens[-1, 1], sections[-1, 1] if len(sections) else 0)]])) \
        if len(tokens) else np.zeros(1, dtype=np.int64)
    mid = np.searchsorted(sections[:, 0], cuts[:-1], side="right") - 1
    owner = np.where((mid >= 0) & (cuts[:-1] < sections[mid, 1]), mid, -1) if len(sections) else np.full(max(len(cuts) - 1, 0), -1)
    first = np.searchsorted(cuts, tokens[:, 0], side="right") - 1
    last = np.searchsorted(cuts, tokens[:, 1] - 1, side="right") - 1
    crosses = first != last
    section = owner[first] if len(owner) else np.full(len(tokens), -1)
    if rule == "majority":
        for t in np.flatnonzero(crosses).tolist():
            part = np.arange(first[t], last[t] + 1)
            held = np.minimum(cuts[part + 1], tokens[t, 1]) - np.maximum(cuts[part], tokens[t, 0])
            section[t] = owner[part[held.argmax()]]
    return section, crosses


def count_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                   spans: Callable[[str], np.ndarray] = sentences, rule: str = "majority") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens), one row per section of every row.

    ``n_crossing`` counts the section's tokens that reach into another one.
    A row for section -1 is there only if it holds tokens.  Null and empty
    texts have one section of no tokens.  Repeated rows stay repeated; other
    columns are ignored.  ``spans`` gives the sections of a text, disjoint,
    in order and not empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer_path or byte_bpe_path()

    def run(batches):
        encoder = ByteEncoder(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in chunks(texts):
                parts = []
                for text, ids in zip(texts[a:b], encoder.encode_each(texts[a:b])):
                    own = spans(text) if text else np.zeros((1, 2), dtype=np.int64)
                    number = np.arange(len(own))
                    if len(ids):
                        section, crosses = join_spans(token_spans(text, ids, encoder.width), own, rule)
                        n = np.bincount(section + 1, minlength=len(own) + 1)
                        crossing = np.bincount(section + 1, weights=crosses, minlength=len(own) + 1).astype(np.int64)
                        if n[0]:
                            own, number = np.concatenate([[[0, len(text)]], own]), np.arange(-1, len(own))
                        else:
                            n, crossing = n[1:], crossing[1:]
                    else:
                        n = crossing = np.zeros(len(own), dtype=np.int64)
                    parts.append((number, own[:, 0], own[:, 1], n, crossing, np.full(len(own), len(ids))))
                size = [len(p[0]) for p in parts]
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].repeat(size).reset_index(drop=True), **dict(zip(
                    ("section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"), columns))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def count_fields(rows: DataFrame, fields: list[str], id_col: str, joiner: str = "\n", tokenizer_path: str | None = None,
                 rule: str = "majority") -> DataFrame:
    """``count_sections`` of the text made of ``fields`` joined by ``joiner``, section k being field k.

    A null or empty field has no row.  The joiner's tokens are in
    section -1 where the rule doesn't give them to a field.  Repeated rows stay
    repeated, a null id stays null, an empty table gives an empty result.
    """
    own = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    made = rows.select(F.col(id_col).alias("doc_id"), F.array(*[F.length(c).cast("long") for c in own]).alias("sizes"),
                       F.concat_ws(joiner, *own).alias("text"))
    path, gap = tokenizer_path or byte_bpe_path(), len(joiner)

    def run(batches):
        encoder = ByteEncoder(path)
        for batch in batches:
            out = []
            for doc_id, sizes, text in zip(batch["doc_id"], batch["sizes"], batch["text"]):
                size = np.asarray(sizes, dtype=np.int64)
                start = np.cumsum(size + gap) - size - gap
                full = np.flatnonzero(size)
                ids = encoder.encode([text])[0]
                section, crosses = join_spans(token_spans(text, ids, encoder.width), np.column_stack([start, start + size])[full], rule)
                for k in sorted(set(section.tolist()) | set(range(len(full)))):
                    a, b = (int(start[full[k]]), int(start[full[k]] + size[full[k]])) if k >= 0 else (0, len(text))
                    mine = section == k
                    out.append((doc_id, int(full[k]) if k >= 0 else -1, a, b, int(mine.sum()), int((mine & crosses).sum()), len(ids)))
            yield pd.DataFrame(out, columns=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = rows.schema[id_col].dataType.simpleString()
    return made.mapInPandas(run, f"doc_id {kind}, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
