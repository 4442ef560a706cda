"""Language identification by cross-parsing entropy.

For each language, a suffix automaton holds a bounded sample of labelled text. A document is parsed against each: from where
a phrase begins, the automaton gives the longest match in that language's sample, then the next phrase begins. The cost
of a language is its phrases a character times the log of its sample's length; the lowest cost wins.

Texts are lower case letters and single blanks; everything else counts as a blank. Stretches of STRETCH characters are parsed side
by side, a character of each at a step, as if a phrase began with each. Then the parse is put together over the ends: from the
state in which the stretch before really ends, a stretch is parsed anew until both parses are in one state, from where on they are the same. So the
phrases are those of the whole text, whatever its length. Null texts and texts without letters are `und` with score 0, as is every text if nothing is labelled. Ties go to
the first language by name. Repeated rows are judged one by one; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Columns of the table of transitions. Every character of a sample has a code; those past the columns, the rarest, have
#: their transitions in a sorted list. The last code is that of all characters which no sample has.
ALPHABET = 60
#: Bytes of the table at most, which every worker holds, whatever the number of languages.
MODEL_BYTES = 256 << 20
#: Characters of labelled text in each language and of a row at most, and in all languages together: the bound of the fit.
#: An automaton has at most two states a character, and a state ALPHABET numbers of four bytes.
LANGUAGE_CHARS, ROW_CHARS, TOTAL_CHARS = 60_000, 4_000, MODEL_BYTES // (2 * 4 * ALPHABET)
STRETCH = 1024


class SuffixAutomaton:
    """All substrings of a string of codes, as a table of transitions; state 0 is the empty string.

    Codes from n_codes - 1 on have no column: their transitions are rare, rows of state, code, next state.
    """

    def __init__(self, codes: np.ndarray, n_codes: int):
        link, length, follow = [-1], [0], [{}]
        last = 0
        for c in codes.tolist():
            now = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            at = last
            while at >= 0 and c not in follow[at]:
                follow[at][c] = now
                at = link[at]
            if at >= 0:
                to = follow[at][c]
                if length[to] == length[at] + 1:
                    link[now] = to
                else:  # to's shorter strings get a state of their own
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    follow.append(dict(follow[to]))
                    while at >= 0 and follow[at].get(c) == to:
                        follow[at][c] = twin
                        at = link[at]
                    link[to] = link[now] = twin
            last = now
        self.table = np.full((len(length), n_codes), -1, np.int32)
        rare = []
        for state, out in enumerate(follow):
            for c, to in out.items():
                if c < n_codes - 1:
                    self.table[state, c] = to
                else:
                    rare.append((state, c, to))
        self.rare = np.array(rare, np.int64).reshape(-1, 3)
        self.size = len(codes)


def plain(text: str) -> str:
    """Lower-case letters, single blanks between them."""
    return " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split())


class Alphabet:
    """Codes of characters, looked up by code point."""

    def __init__(self, samples: dict[str, str]):
        seen: dict[str, int] = {}
        for s in samples.values():
            for c in s:
                seen[c] = seen.get(c, 0) + 1
        chars = sorted(seen, key=lambda c: (-seen[c], c))
        self.n = len(chars) + 1
        self.of = np.full(0x110000, self.n - 1, np.int32)
        self.of[[ord(c) for c in chars]] = np.arange(len(chars))
        blank = self.of[32] if " " in chars else self.n - 1
        # every code point at once: letters fold to lower case, the rest to a blank
        self.raw = np.full(0x110000, blank, np.int32)
        self.letter = np.zeros(0x110000, bool)
        for o in range(0x40000):
            c = chr(o)
            if c.isalpha():
                self.letter[o] = True
                self.raw[o] = self.of[ord(c.lower()[0])]

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """(codes, with runs of other characters as one blank; whether it has a letter)."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        letter = self.letter[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        return self.raw[points[keep]], bool(letter.any())


class Model:
    """An automaton per language over one alphabet, as one table."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet(samples)
        self.width = min(self.alphabet.n, ALPHABET)
        parts, roots, bits, at = [], [], [], 0
        keys, nexts = [], []
        for lang in self.langs:
            codes, _ = self.alphabet.encode(samples[lang])
            a = SuffixAutomaton(codes, self.width)
            parts.append(np.where(a.table >= 0, a.table + at, -1))
            keys.append((a.rare[:, 0] + at) * self.alphabet.n + a.rare[:, 1])
            nexts.append((a.rare[:, 2] + at).astype(np.int32))
            roots.append(at)
            bits.append(math.log2(max(2, a.size)))
            at += len(a.table)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
        keys, nexts = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*nexts, np.zeros(0, np.int32)])
        order = np.argsort(keys)
        self.rare_keys, self.rare_next = keys[order], nexts[order]
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next state of each, or -1; c has the shape of state, or of one of its rows."""
        last = self.width - 1
        now = self.table[state * self.width + np.minimum(c, last)]
        if len(self.rare_keys) and (c >= last).any():
            at = np.nonzero(np.broadcast_to(c >= last, state.shape))
            key = state[at].astype(np.int64) * self.alphabet.n + np.broadcast_to(c, state.shape)[at]
            place = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            now[at] = np.where(self.rare_keys[place] == key, self.rare_next[place], -1)
        return now

    def advance(self, state: np.ndarray, count: np.ndarray, c: np.ndarray) -> None:
        """One character further, in place: the states of languages by stretches, and the phrases that have ended."""
        now = self.follow(state, c)
        rows, cols = np.nonzero(now < 0)
        if len(rows):  # a phrase ends here, and the next begins with this character
            again = self.follow(self.roots[rows], c[cols])
            # the phrase that was under way, and this character alone if the sample hasn't got it
            count[rows, cols] += (state[rows, cols] != self.roots[rows]).astype(np.int32) + (again < 0)
            now[rows, cols] = np.where(again < 0, self.roots[rows], again)
        state[:] = now

    def corrected(self, grid: np.ndarray, sizes: np.ndarray, enter: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases more than if a phrase began with the stretch, end states) of stretches entered in these states.

        grid: a column a stretch, of these sizes; ends: the states in which the parses from the root end.
        """
        more, out = np.zeros(enter.shape, np.int32), ends.copy()
        roots = np.repeat(self.roots[:, None], len(sizes), 1)
        at = np.flatnonzero((enter != roots).any(0))
        mine, other, step = enter[:, at], roots[:, at], 0
        mine_n, other_n = np.zeros(mine.shape, np.int32), np.zeros(mine.shape, np.int32)
        while len(at):
            live = (mine != other).any(0) & (sizes[at] > step)
            if not live.all():
                gone = ~live
                more[:, at[gone]] = mine_n[:, gone] - other_n[:, gone]
                out[:, at[gone]] = np.where(mine[:, gone] == other[:, gone], out[:, at[gone]], mine[:, gone])
                at, mine, other, mine_n, other_n = at[live], mine[:, live], other[:, live], mine_n[:, live], other_n[:, live]
                if not len(at):
                    break
            c = grid[step, at]
            self.advance(mine, mine_n, c)
            self.advance(other, other_n, c)
            step += 1
        return more, out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each text: an array of texts by languages."""
        stretches = [(i, k, t[at : at + STRETCH]) for i, t in enumerate(texts) for k, at in enumerate(range(0, len(t), STRETCH))]
        stretches.sort(key=lambda x: -len(x[2]))
        n_langs, n = len(self.langs), len(stretches)
        sizes = np.array([len(x[2]) for x in stretches], np.int64)
        grid = np.zeros((max(1, int(sizes.max(initial=0))), n), np.int32)
        for j, x in enumerate(stretches):
            grid[: sizes[j], j] = x[2]
        roots = np.repeat(self.roots[:, None], n, 1)
        state, count = roots.copy(), np.zeros((n_langs, n), np.int32)
        alive = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")  # how many have a character at this step
        for step, m in enumerate(alive.tolist()):
            self.advance(state[:, :m], count[:, :m], grid[step, :m])
        place = {(i, k): j for j, (i, k, _) in enumerate(stretches)}
        later = np.array([j for j, (_, k, _) in enumerate(stretches) if k], np.int64)
        before = np.array([place[i, k - 1] for i, k, _ in stretches if k], np.int64)
        more, ends, entered = np.zeros_like(count), state.copy(), roots.copy()
        todo = np.arange(len(later))
        while len(todo):
            j, b = later[todo], before[todo]
            entered[:, j] = ends[:, b]
            more[:, j], ends[:, j] = self.corrected(grid[:, j], sizes[j], ends[:, b], state[:, j])
            # only a stretch whose parses never met changes what comes after it
            todo = np.flatnonzero((entered[:, later] != ends[:, before]).any(0))
        out = np.zeros((len(texts), n_langs), np.int64)
        np.add.at(out, np.array([i for i, _, _ in stretches], np.int64), (count + more).T)
        last = [place[i, (len(t) - 1) // STRETCH] for i, t in enumerate(texts) if len(t)]
        # the phrase that the end cuts off
        out[[i for i, t in enumerate(texts) if len(t)]] += (ends[:, last] != roots[:, last]).T
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [self.alphabet.encode(t) if t else (np.zeros(0, np.int32), False) for t in texts]
        total = self.phrases([c for c, _ in codes]) if self.langs else np.zeros((len(texts), 0))
        langs, scores = [], []
        for (c, letters), phrases in zip(codes, total, strict=True):
            if not letters or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            cost = phrases * self.bits / len(c)
            best = int(np.argmin(cost))
            rest = np.delete(cost, best)
            langs.append(self.langs[best])
            # from 0, a draw with the runner-up, to 1
            scores.append(float(1 - cost[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0 - float(len(rest) > 0))
        return langs, scores


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a bounded sample of labelled rows: which rows, a hash of doc_id decides. Every language has a sample."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.substring(text_col, 1, ROW_CHARS).alias("t"))
    rows = rows.filter(F.col("t").rlike("\\p{L}")).withColumn("h", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    each = max(1, min(LANGUAGE_CHARS, TOTAL_CHARS // max(1, len(counts))))
    want = 8 * (each // 1000 + 1)
    # the row with the least hash is in the sample, whatever the share
    shares = [(r["lang"], max(r["least"] + 1, int(1_000_000 * min(1.0, want / r["n"])))) for r in counts]
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long")), "lang").filter("h < share")
    sample = chosen.select("lang", "id", "t").collect()
    texts: dict[str, str] = {}
    seen: set[str] = set()
    for r in sorted(sample, key=lambda r: (r["lang"], str(r["id"]))):
        t = plain(r["t"])
        own = texts.get(r["lang"], "")
        if t and t not in seen and len(own) < each:
            seen.add(t)
            texts[r["lang"]] = f"{own} {t}".strip()[:each]
    return Model(texts)


def language_id(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    held = spark.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col) if model is None else model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = held.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")
