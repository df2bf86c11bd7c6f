"""Structure-aware chunks: blocks under a trail of headings, packed to a size, with an overlap carried between chunks of one trail.

A slab of a batch of texts is one table of lines in pandas: running sums tell blocks apart, filled-down columns hold the last heading
of each depth, and only the packing of lengths and the carrying of overlaps go step by step. No row leaves its batch, so
nothing is shuffled. Lengths and offsets count characters. Null and blank texts have no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Default size and overlap, least length that closes a chunk, characters a token, and what makes a line a heading.
SIZE, OVERLAP, LEAST, CHARS_PER_TOKEN = 1200, 120, 80, 3.6
SMALLEST = 200
#: Characters of text that are one table at a time; a batch of rows may hold any number.
SLAB = 1 << 21
HEADING = r"^(#{1,6})\s+(.+?)\s*#*$"
LONE_LINE = r"[^\n.!?]{3,80}"
NOT_AT_END = list(".!?:;,")
SENTENCE_END = r"(?<=[.!?…])\s+"

DEPTHS = range(1, 7)
COLUMNS = ["index", "text", "headings", "chars", "estimated_tokens", "start", "end"]


def lines_of(texts: pd.Series) -> pd.DataFrame:
    """(doc, line, at): every line of every text, with where it starts; at most one blank line in a row, line feeds only."""
    clean = texts.fillna("").str.replace(r"\r\n?", "\n", regex=True).str.replace(r"\n{3,}", "\n\n", regex=True)
    split = clean.reset_index(drop=True).str.split("\n").explode()
    out = pd.DataFrame({"doc": split.index.to_numpy(), "line": split.to_numpy()}, dtype=object).astype({"doc": "int64"})
    width = out["line"].str.len().astype("int64") + 1
    out["at"] = width.groupby(out["doc"]).cumsum() - width
    return out


def blocks_of(lines: pd.DataFrame) -> pd.DataFrame:
    """(doc, at, trail, text): runs of lines between blank lines and headings, under the titles that hold there.

    Of a run of text lines the first ones that look like titles are headings of depth 1; from the first other line on, all are body.
    """
    bare = lines["line"].str.strip()
    marks = lines["line"].str.extract(HEADING)
    text = (bare != "") & marks[0].isna()
    title_like = text & bare.str.fullmatch(LONE_LINE) & ~bare.str[-1:].isin(NOT_AT_END)
    run = (~text).cumsum()
    body = text & (text & ~title_like).groupby([lines["doc"], run]).cummax()
    depth = marks[0].str.len().where(~text, 1).where(~body)
    title = marks[1].str.strip().where(~text, bare)
    place = pd.Series(np.arange(len(lines), dtype=float), index=lines.index)
    titles, places = {}, {}
    for k in DEPTHS:
        own = depth == k
        titles[k] = title.where(own).groupby(lines["doc"]).ffill()
        places[k] = place.where(own).groupby(lines["doc"]).ffill().fillna(-1.0)
    # A heading holds as long as none of its depth or above has followed.
    above = pd.Series(-1.0, index=lines.index)
    held = pd.DataFrame(index=lines.index)
    for k in DEPTHS:
        held[k] = titles[k].where(places[k] > above)
        above = np.maximum(above, places[k])
    own = lines[body].assign(run=run[body])
    heads = own.groupby(["doc", "run"], sort=False)
    out = heads.agg(doc=("doc", "first"), at=("at", "first"), text=("line", "\n".join)).reset_index(drop=True)
    first = own.index[~own.duplicated(["doc", "run"])]
    out["trail"] = [tuple(x for x in row if isinstance(x, str)) for row in held.loc[first].to_numpy(dtype=object)]
    out["text"] = out["text"].str.strip() if len(out) else out["text"]
    return out


def pieces_of(blocks: pd.DataFrame, size: int) -> pd.DataFrame:
    """Blocks that fit, whole; of others the sentences, of which longer ones are cut to the size."""
    long = blocks["text"].str.len() > size
    out = blocks.assign(text=[[x] for x in blocks["text"]])
    if long.any():
        sentences = blocks.loc[long, "text"].str.split(SENTENCE_END, regex=True)
        out.loc[long, "text"] = pd.Series([[s[i : i + size] for s in own for i in range(0, len(s), size)] for own in sentences], index=sentences.index, dtype=object)
    return out.explode("text", ignore_index=True).dropna(subset=["text"])


def packed(width: np.ndarray, section: np.ndarray, size: int) -> np.ndarray:
    """The number of each piece's chunk: one ends with its section, or when the next piece would pass the size and it isn't a scrap."""
    out, chunk, filled, before = np.zeros(len(width), dtype=np.int64), -1, 0, None
    for i, (w, s) in enumerate(zip(width.tolist(), section.tolist(), strict=True)):
        if s != before or (filled >= LEAST and filled + w > size):
            chunk, filled, before = chunk + 1, 0, s
        out[i] = chunk
        filled += w + 2
    return out


def chunks(texts: pd.Series, size: int = SIZE, overlap: int = OVERLAP, headings: bool = False) -> pd.DataFrame:
    """A row for each chunk of each text: doc (its place in texts) and COLUMNS."""
    size = max(SMALLEST, size)
    overlap = max(0, min(overlap, size // 2))
    pieces = pieces_of(blocks_of(lines_of(texts)), size)
    if pieces.empty:
        return pd.DataFrame(columns=["doc", *COLUMNS])
    section = ((pieces["doc"] != pieces["doc"].shift()) | (pieces["trail"] != pieces["trail"].shift())).cumsum()
    number = packed(pieces["text"].str.len().to_numpy(), section.to_numpy(), size)
    out = pieces.assign(section=section).groupby(number, sort=False).agg(doc=("doc", "first"), section=("section", "first"), start=("at", "first"), headings=("trail", "first"), body=("text", "\n\n".join))
    out["body"] = out["body"].str.strip()
    out = out[out["body"] != ""]
    whole, last, before = [], "", None
    for s, trail, body in zip(out["section"], out["headings"], out["body"], strict=True):
        carried = last[-overlap:] + " " if overlap and s == before else ""
        last, before = (" › ".join(trail) + "\n\n" if headings and trail else "") + carried + body, s
        whole.append(last)
    chars = pd.Series(whole, index=out.index, dtype=object).str.len().astype("int64")
    out = out.assign(text=whole, chars=chars, estimated_tokens=np.ceil(chars / CHARS_PER_TOKEN).astype("int64"), end=out["start"] + out["body"].str.len(), headings=out["headings"].map(list))
    return out.assign(index=out.groupby("doc").cumcount())[["doc", *COLUMNS]]


def slabs(batch: pd.DataFrame, most: int = SLAB) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose texts come to at most `most` characters, or one longer text each."""
    ends = batch["body"].str.len().fillna(0).astype("int64").cumsum().to_numpy()
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield batch.iloc[i:j]
        i = j


def chunk(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP, headings: bool = False) -> DataFrame:
    """One row per chunk: id_col, index, text, headings, chars, estimated_tokens, start, end. A repeated row has chunks of its own."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slabs(batch):
                out = chunks(part["body"], size, overlap, headings)
                own = pd.Series(part["id"].to_numpy(dtype=object)).iloc[out["doc"].astype("int64")]
                yield out.drop(columns="doc").assign(id=own.to_numpy())[["id", *COLUMNS]]

    own = docs.select(docs[id_col].alias("id"), docs[text].alias("body"))
    return own.mapInPandas(run, f"id {kind}, index int, text string, headings array<string>, chars int, estimated_tokens int, start int, end int").withColumnRenamed("id", id_col)
