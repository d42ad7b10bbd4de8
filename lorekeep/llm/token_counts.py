"""Token counts by heap-and-linked-list byte-pair merging (operator 10).

A text is split into chunks that no vocabulary piece can cross, so merging each chunk alone is exact. In a chunk, the
symbols form a linked list and the adjacent pairs that the vocabulary holds wait in a heap by rank, then by place; the
best pair is popped and merged until none is left. Count = initial symbols minus merges; ids are never formed. A
character that the vocabulary lacks and that took part in no merge counts as its UTF-8 bytes.

Null and empty texts have 0 tokens; ties of rank go to the leftmost pair; repeated rows and very long texts are counted
like any others (memory is bounded by one text and a cache of ``CACHE`` chunks of at most ``LONGEST`` characters); extra columns are ignored.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, need, table

#: Chunks of up to LONGEST characters that are kept with their count, and how many.
CACHE, LONGEST = 1 << 19, 40
LIMIT = 4096


def load_ranks(path: str) -> tuple[dict[str, int], bool]:
    """Piece -> rank (lower merges first, equal scores share a rank) of a ``.model`` file; whether it has byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids}, reverse=True))}
    if sp.normalize("  a\tb ﬁ ") != "▁▁▁a\tb▁ﬁ▁":
        raise ValueError("only models that keep white space, add a leading space and don't normalise are supported")
    return {sp.id_to_piece(i): order[sp.get_score(i)] for i in ids}, any(sp.is_byte(i) for i in range(sp.get_piece_size()))


def merge_count(chunk: str, rank: dict[str, int]) -> int:
    """Tokens of one chunk (spaces already written as U+2581)."""
    sym = list(chunk)
    n = len(sym)
    shift = n.bit_length()
    low = (1 << shift) - 1
    heap = [rank[p] << shift | i for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in rank]
    if heap:
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        left = n
        while heap:
            top = heappop(heap)
            i = top & low
            a = sym[i]
            if not a or (j := after[i]) >= n:
                continue
            p = a + sym[j]
            if rank.get(p, -1) != top >> shift:
                continue
            sym[i], sym[j] = p, ""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := p + sym[k]) in rank:
                    heappush(heap, rank[q] << shift | i)
            if (h := before[i]) >= 0 and (q := sym[h] + p) in rank:
                heappush(heap, rank[q] << shift | h)
    else:
        left = n
    return left + sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in sym if s and s not in rank)


class _Counts(dict):
    def __init__(self, rank: dict[str, int]):
        super().__init__()
        self.rank = rank

    def __missing__(self, chunk: str) -> int:
        n = merge_count(chunk.replace(" ", "▁"), self.rank)
        if len(chunk) > LONGEST:
            return n
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = n
        return n


def chunker(rank: dict[str, int]):
    """The splitter for a vocabulary: before a run of spaces, and around line ends, unless a piece crosses there."""
    crosses = any("▁" in p.lstrip("▁") for p in rank)
    lines = any("\n" in p and len(p) > 1 for p in rank)
    if crosses:
        return lambda text: [text]
    return re.compile(" *[^ ]+| +" if lines else r" *[^ \n]+| +(?=\n|\Z)|\n").findall


def token_counts(df: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row of ``df``. One narrow pass; no shuffle."""
    rank, has_bytes = load_ranks(model_path)
    if not has_bytes:
        raise ValueError("a model without byte pieces maps unknown characters to one id; not supported")
    shared = df.sparkSession.sparkContext.broadcast(rank)  # one vocabulary: a fixed size of a few MB

    def run(batches):
        counts = _Counts(shared.value)
        chunks = chunker(shared.value)
        get = counts.__getitem__
        for b in batches:
            sizes, tokens = [], []
            for t in b[text]:
                t = t or ""
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                tokens.append(sum(map(get, chunks(" " + t.replace("▁", " ")))) if t else 0)
            yield {key: b[key], "n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(need(df, key, text), run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), model_path)
