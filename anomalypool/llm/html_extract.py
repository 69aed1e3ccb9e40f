"""Main text of web pages: what a host repeats on its pages, by a suffix array of their token streams, and the markup as one input.

Markup gives blocks in zones (html_blocks). The blocks of every page that are not plainly article, menus and footers
included, are its streams; the host's suffix array tells which of their tokens stand in strings of MIN_TOKENS tokens
that another page of the host has too (host_suffixes). Then a page's text is the article, or what is main if there is
none, or else what no zone claims. Of blocks in plain article or main all stays; blocks of a doubtful zone, and those
that no zone claims, lose what is repeated: the block, if all its tokens are, otherwise only stretches of MIN_PROSE
tokens or more, so that prose keeps the phrases that pages share by chance.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, materialise, per_batch
from .host_suffixes import page_hashes, repeated_strings
from .html_blocks import page_blocks

MIN_TOKENS = 6  # least length of a repeated string
MIN_PROSE = 10  # least length of a repeated stretch that is cut out of a block with other tokens

Blocks = list[tuple[str, str]]


def host_of(url: str) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url.lower())
    return m[1] if m else ""


def level_of(blocks: Blocks) -> str:
    """The zone that a page's text is in: article, else main, else open."""
    zones = {z.rstrip("?") for z, _ in blocks}
    return next((z for z in ("article", "main") if z in zones), "open")


def streams_of(blocks: Blocks) -> list[str]:
    """The texts of blocks that are not plainly article, joined; apart where article lies between."""
    return [" ".join(t for _, t in part) for claimed, part in groupby(blocks, lambda b: b[0] == "article") if not claimed]


def text_without(blocks: Blocks, repeated: set[int]) -> str:
    """The page's text, where repeated are the positions in its streams of tokens that its host repeats."""
    level, out, first = level_of(blocks), [], 0
    for zone, text in blocks:
        if zone == "article":
            out.append(text)
            continue
        words = text.split(" ")
        stretches = [(gone, list(own)) for gone, own in groupby(range(len(words)), lambda i: first + i in repeated)]
        first += len(words)
        if zone.rstrip("?") != level:
            continue
        if zone == "main":
            out.append(text)
        elif any(not gone for gone, _ in stretches):
            out.append(" ".join(words[i] for gone, own in stretches if not gone or len(own) < MIN_PROSE for i in own))
    return "\n".join(out)


def _covered(begins: Iterable[int]) -> set[int]:
    return {i for at in begins for i in range(at, at + MIN_TOKENS)}


def _rows(pages: DataFrame, url_col: str, html_col: str, *kept: str) -> DataFrame:
    return pages.select(*kept, F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))


def _key(url: bytes, raw: bytes) -> bytes:
    """128 bits of all that a page's text depends on, so that the second reading finds what the first told of it."""
    return xxhash.xxh3_128_digest(url + b"\0" + raw)


def page_streams(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """_row (the page's key), _host, _about (hash of what it is about), _tokens and _streams of every page."""
    names = ["_row", "_host", "_about", "_tokens", "_streams"]
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        made = []
        for url, raw in zip(byte_list(batch.column(0)), byte_list(batch.column(1))):
            blocks = page_blocks(raw.decode("utf-8", "replace"))
            level, streams = level_of(blocks), streams_of(blocks)
            about = xxhash.xxh64_intdigest("\n".join(t for z, t in blocks if z.rstrip("?") == level).encode("utf-8", "replace"))
            made.append((_key(url, raw), host_of(url.decode("utf-8", "replace")), about - (1 << 63), sum(s.count(" ") + 1 for s in streams), streams))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    return _rows(pages, url_col, html_col).mapInArrow(per_batch(lambda: step), "_row binary, _host string, _about bigint, _tokens int, _streams array<string>")


def packed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """_page, _url, _row (the page's key), _blocks (its blocks, packed, as they are to travel) of every page."""
    rows = _rows(pages, url_col, html_col, F.col(id_col).alias("_page"))

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        keys, packed = [], []
        for url, raw in zip(byte_list(batch.column(1)), byte_list(batch.column(2))):
            keys.append(_key(url, raw))
            packed.append(zlib.compress(json.dumps(page_blocks(raw.decode("utf-8", "replace")), ensure_ascii=False).encode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["_page", "_url", "_row", "_blocks"])

    return rows.mapInArrow(per_batch(lambda: step), f"_page {rows.schema['_page'].dataType.simpleString()}, _url string, _row binary, _blocks binary")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int | None = None) -> DataFrame:
    """id, url, text, n_chars, n_tokens, n_repeated: the main text of every page, empty if it has none.

    n_chars are the text's code points. n_tokens are the tokens of the page's streams, n_repeated those of them that
    its host repeats. Pages with the same text at their level (copies of an article) don't make each other's tokens
    repeated. Null html counts as empty, null urls as one host without a name. Repeated ids give repeated rows. Very
    long pages are parsed whole. No rows give none; columns other than the three are not looked at. Pages are told apart
    by 128-bit hashes, strings in different blocks of one host by 64 bits.
    """
    streams = materialise(page_streams(pages, url_col, html_col), "html-streams")
    found = repeated_strings(streams, MIN_TOKENS, block)
    # pages are parsed a second time, as that costs less than writing all their texts in between
    joined = packed_pages(pages, id_col, url_col, html_col).join(found, "_row", "left")

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts, sizes, counts = [], [], []
        for packed, begins, elsewhere in zip(*(batch.column(c).to_pylist() for c in ("_blocks", "_found", "_elsewhere"))):
            blocks = json.loads(zlib.decompress(packed))
            repeated = _covered(begins or ())
            if elsewhere:
                at, hashes = page_hashes([s.split(" ") for s in streams_of(blocks)], MIN_TOKENS)
                repeated |= _covered(at[np.isin(hashes, np.array(elsewhere, dtype=np.int64).view(np.uint64))].tolist())
            texts.append(text_without(blocks, repeated))
            sizes.append(sum(s.count(" ") + 1 for s in streams_of(blocks)))
            counts.append(len(repeated))
        yield pa.RecordBatch.from_arrays([batch.column("_page"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int32())], names=["_page", "_url", "_text", "_tokens", "_repeated"])

    kind = joined.schema["_page"].dataType.simpleString()
    done = joined.mapInArrow(per_batch(lambda: step), f"_page {kind}, _url string, _text string, _tokens int, _repeated int")
    return done.select(
        F.col("_page").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"),
        F.col("_tokens").cast("long").alias("n_tokens"), F.col("_repeated").cast("long").alias("n_repeated"),
    )
