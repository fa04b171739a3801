"""Token counts that follow edits.

A document is kept as its pre-tokens (the matches of the splitting pattern) in the
leaves of a segment tree whose nodes sum characters and tokens. An edit finds its
place by the sums, re-splits only the pre-tokens it touches and those around them
until an old border is met again, encodes those anew, and updates the sums on the
paths to the leaves that changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import bpe

# Pre-tokens of a leaf when a tree is built; a leaf may grow to four times that.
LEAF = 32
COUNTS_KEPT = 500_000
EDITS = "array<struct<at:bigint,removed:bigint,inserted:string>>"


class TokenTree:
    """Pre-tokens of a text with sums of characters and tokens.

    ``recounted`` counts the pre-tokens that edits had to encode.
    """

    def __init__(self, text: str, split: regex.Pattern, count: Callable[[str], int]):
        self.split, self.count, self.recounted = split, count, 0
        self._build(split.findall(text))

    def _build(self, parts: list[str]) -> None:
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        count = self.count
        chars = [sum(map(len, leaf)) for leaf in self.leaves]
        tokens = [sum(map(count, leaf)) for leaf in self.leaves]
        rest = [0] * (self.size - len(self.leaves))
        self.chars, self.tokens = [0] * self.size + chars + rest, [0] * self.size + tokens + rest
        for node in range(self.size - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(part for leaf in self.leaves for part in leaf)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Put ``inserted`` in place of ``removed`` characters from ``at``; places beyond the text are its end."""
        at = min(max(at, 0), self.n_chars)
        removed = min(max(removed, 0), self.n_chars - at)
        # A match looks at most two characters past its end (white space gives one back
        # before a word), so those that end earlier saw nothing of the edit.
        leaf, index, start = self._reaching(max(0, at - 1))
        following = self._from(leaf, index)
        touched, end = 0, start  # end: of the old pre-tokens taken so far
        buffer, borders = "", []
        stop = at + removed
        while end < stop or not buffer:
            part = next(following, None)
            if part is None:
                break
            buffer += part
            end += len(part)
            touched += 1
        buffer = buffer[: at - start] + inserted + buffer[stop - start :]
        while True:
            # Take more old pre-tokens, and look for an old border that the new splitting meets.
            complete, more = False, max(4, len(borders))
            for _ in range(more):
                part = next(following, None)
                if part is None:
                    complete = True
                    break
                borders.append(len(buffer))
                buffer += part
            fresh = self.split.findall(buffer)
            ends = list(accumulate(map(len, fresh)))
            old = dict(zip(borders, range(len(borders))))
            least = at - start + len(inserted)
            met = next((i for i, e in enumerate(ends) if e in old and e >= least and (complete or e + 1 < len(buffer))), None)
            if met is not None:
                kept, gone = fresh[: met + 1], touched + old[ends[met]]
                break
            if complete:
                kept, gone = fresh, touched + len(borders)
                break
        self.recounted += len(kept)
        self._replace(leaf, index, gone, kept)

    def _reaching(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and start of the first pre-token that ends at or after ``at``."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.chars[node] < at:
                start += self.chars[node]
                node += 1
        leaf = node - self.size
        if leaf >= len(self.leaves):
            leaf = len(self.leaves) - 1
        for index, part in enumerate(self.leaves[leaf]):
            if start + len(part) >= at:
                return leaf, index, start
            start += len(part)
        return leaf, len(self.leaves[leaf]), start

    def _from(self, leaf: int, index: int) -> Iterator[str]:
        yield from self.leaves[leaf][index:]
        for later in range(leaf + 1, len(self.leaves)):
            yield from self.leaves[later]

    def _replace(self, leaf: int, index: int, gone: int, parts: list[str]) -> None:
        """Other pre-tokens in place of ``gone`` ones; they all go to the first leaf."""
        changed, first = [leaf], self.leaves[leaf]
        here = min(gone, len(first) - index)
        self.leaves[leaf] = first[:index] + parts + first[index + here :]
        gone -= here
        while gone:
            leaf += 1
            here = min(gone, len(self.leaves[leaf]))
            self.leaves[leaf] = self.leaves[leaf][here:]
            gone -= here
            if here:
                changed.append(leaf)
        if len(self.leaves[changed[0]]) > 4 * LEAF:
            self._build([part for leaf_ in self.leaves for part in leaf_])
            return
        for one in changed:
            node = one + self.size
            chars = sum(map(len, self.leaves[one])) - self.chars[node]
            tokens = sum(map(self.count, self.leaves[one])) - self.tokens[node]
            while node:
                self.chars[node] += chars
                self.tokens[node] += tokens
                node //= 2


@cache
def counter(path: str, pattern: str) -> tuple[regex.Pattern, Callable[[str], int]]:
    """The splitting pattern, and the number of tokens of a pre-token; one per Python worker."""
    vocabulary, known = bpe.vocabulary(path), {}

    def count(part: str) -> int:
        found = known.get(part)
        if found is None:
            data = part.encode()
            found = 1 if data in vocabulary.ids else len(bpe.Piece(vocabulary, data).ids())
            if len(known) < COUNTS_KEPT:
                known[part] = found
        return found

    return bpe.splitter(pattern), count


def recount(
    documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", edits: str = "edits"
) -> DataFrame:
    """Token counts of each text before and after its edits.

    ``edits`` is an array of (at, removed, inserted), in the order they are made;
    places count code points of the text as edited so far, and those beyond it are
    its end. Columns ``key``, ``n_chars``, ``n_tokens``, ``edited_chars``,
    ``edited_tokens``, and ``recounted``, the pre-tokens that the edits encoded.

    A NULL text is empty, NULL edits are none, a NULL field of an edit is 0 or
    nothing. Repeated and NULL keys keep their rows; other columns are not read; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = counter(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for body, changes in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tree = TokenTree(body, split, count)
                    before = tree.n_chars, tree.n_tokens
                    for change in changes or ():
                        if change is not None:
                            tree.edit(change["at"] or 0, change["removed"] or 0, change["inserted"] or "")
                    rows.append((*before, tree.n_chars, tree.n_tokens, tree.recounted))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["k", *names])

    names = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "recounted"]
    rows = documents.select(
        F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.col(edits).cast(EDITS).alias("e")
    )
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} bigint" for n in names)).withColumnRenamed("k", key)


def drawn_edits(key: str = "doc_id", text: str = "text", number: int = 4) -> F.Column:
    """Edits drawn from the key: each removes up to 24 characters and inserts up to 16 from elsewhere in the text."""
    edits = []
    for i in range(number):
        drawn = [F.crc32(F.concat_ws(":", F.lit(f"{i}{part}"), F.col(key).cast("string"))) for part in "abcd"]
        size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint") + 1
        inserted = F.substring(
            F.coalesce(F.col(text), F.lit("")), (drawn[2] % size + 1).cast("int"), (drawn[3] % 17).cast("int")
        )
        edits.append(F.struct((drawn[0] % size).alias("at"), (drawn[1] % 25).alias("removed"), inserted.alias("inserted")))
    return F.array(*edits)
