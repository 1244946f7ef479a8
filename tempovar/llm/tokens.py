"""Token ids of whole texts, exactly as the ``tokenizers`` library gives them.

A byte-level BPE without a normaliser never joins characters across the start of a " word", nor
across a line feed that stands between two words: a text may be cut before a space unless white
space stands on both sides of it, and before a line feed that follows none. Such tokenizers encode
each distinct unit (a word with the space or the line feed before it) once per worker: a batch of
texts is split and its units numbered by Arrow, only the distinct ones are looked up in a bounded
memo of two generations, and the ids of the texts are gathered by numpy. Unknown units share one
encoding with their stem (letters, before any punctuation) and are encoded many to a call. A text
with an unsafe white space or an added token's string, and every other kind of tokenizer, goes to
the library whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units in each of the two generations of a worker's memo, and the longest unit held.
MEMO_WORDS, MEMO_LENGTH = 500_000, 64
_SPACE = re.compile(r"\s").search
#: A space between white space, or other white space before a line feed, in Arrow's syntax: white space is what ``re`` takes for it.
_WHITE = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if _SPACE(chr(c)))
_UNSAFE = f"[{_WHITE}] (?:[{_WHITE}]|\\z)|[{_WHITE.replace('\\x{a}', '')}]\\n"
_JOINED = 256  # unknown units that are encoded in one call


def _units(text: str) -> str:
    """The text with a space before each line feed that starts a unit, so that spaces alone part units."""
    if "\n" not in text:
        return text
    text = text.replace("\n", " \n")
    while "\n \n" in text:  # line feeds in a row stay together
        text = text.replace("\n \n", "\n\n")
    return text


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                        and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                        and spec["model"]["type"] == "BPE")
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self._added = re.compile("|".join(added)).search if added else lambda text: None
        #: A line feed between words is always a piece of its own: it parts joined units.
        feed = self.library.encode("\n", add_special_tokens=False).ids if self.by_word else []
        self._feed = feed[0] if len(feed) == 1 else None
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._stops: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _safe(self, texts: list[str]) -> list[int]:
        """Which texts may be cut into units; an empty text needs no cut."""
        if not self.by_word or self._feed is None:
            return []
        unsafe = pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNSAFE).to_pylist()
        return [i for i, (t, no) in enumerate(zip(texts, unsafe, strict=True)) if t and not no and not self._added(t)]

    def _joined(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of words without white space, as they are after a space or a line feed (which their ids then hold)."""
        out: dict[str, bytes] = {}
        runs = [words[i:i + _JOINED] for i in range(0, len(words), _JOINED)]
        before, skip = ("\n ", 4) if lead == " " else ("\n", 0)
        for run, got in zip(runs, self.library.encode_batch_fast([before + before.join(run) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            cuts, body = [*(4 * np.flatnonzero(ids == self._feed)).tolist(), 4 * len(ids)], ids.tobytes()
            out.update(zip(run, [body[a + skip:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return out

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of the units: " a" for a, "\na" for "\na". Letters and the punctuation after them are always pieces apart."""
        out: dict[str, bytes] = {}
        for lead, prefix in ((" ", ""), ("\n", "\n")):
            mine = [u[1:] for u in units if u[:1] == "\n"] if prefix else [u for u in units if u[:1] != "\n"]
            words = []
            for i in range(0, len(mine), _JOINED):  # one look at many words; one by one only where there is something odd
                run = mine[i:i + _JOINED]
                if "" in run or _SPACE("".join(run)):
                    for w in run:
                        if not w or _SPACE(w):
                            out[prefix + w] = self.whole(lead + w)
                    run = [w for w in run if w and not _SPACE(w)]
                words += run
            stems = [s if s.isalpha() else w for w, s in zip(words, [w.rstrip(string.punctuation) for w in words], strict=True)]
            wanted = set(stems)
            known = {w: v for w in wanted if (v := self._memo.get(prefix + w)) is not None}
            new = self._joined([w for w in wanted if w not in known] if known else list(wanted), lead)
            out.update(zip([prefix + w for w in new], new.values(), strict=True) if prefix else new)
            known.update(new)
            for word, stem in zip(words, stems, strict=True):
                if len(word) > len(stem):
                    stop = word[len(stem):]
                    if stop not in self._stops:
                        self._stops[stop] = self.whole(stop)
                    out[prefix + word] = known[stem] + self._stops[stop]
        return out

    def _looked_up(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        got = list(map(self._memo.get, units))
        at = [i for i, v in enumerate(got) if v is None]
        if at:
            if len(self._memo) + len(at) > MEMO_WORDS:
                self._older, self._memo = self._memo, {}
            if len(self._stops) > 1000:
                self._stops = {}
            unknown = [units[i] for i in at]
            known = {u: v for u in unknown if (v := self._older.get(u)) is not None} if self._older else {}
            known.update(self._learn([u for u in unknown if u not in known] if known else unknown))
            for i, u in zip(at, unknown, strict=True):
                got[i] = known[u]
            self._memo.update(known if max(map(len, known)) <= MEMO_LENGTH else {u: v for u, v in known.items() if len(u) <= MEMO_LENGTH})
        return got

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        safe = self._safe(texts)
        for i in set(range(len(texts))).difference(safe):
            out[i] = self.whole(texts[i]) if texts[i] else b""
        if not safe:
            return out
        split = pc.split_pattern(pa.array([_units(texts[i]) for i in safe], pa.large_string()), " ")
        offs = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        units, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        # no space stands before the first unit of a text: it is read as one after a line feed, without that
        first = split.flatten().take(pa.array(offs[:-1])).to_pylist()
        plain = list(dict.fromkeys("\n" + f for f in first if f and not f[0].isspace()))
        looked = self._looked_up(list(dict.fromkeys([*units, *plain])))
        ids, after = looked[:len(units)], dict(zip(plain, self._looked_up(plain), strict=True))
        ids += [after["\n" + f][4:] if f and not f[0].isspace() else self.whole(f) if f else b"" for f in first]
        of[offs[:-1]] = len(units) + np.arange(len(first))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, start, n = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size, size[of]
        shift = np.cumsum(n) - n
        flat = flat[np.repeat(start[of] - shift, n) + np.arange(int(n.sum()))].tobytes()
        cuts = [*(4 * shift[offs[:-1]]).tolist(), len(flat)]
        for i, a, b in zip(safe, cuts, cuts[1:], strict=False):
            out[i] = flat[a:b]
        return out


def batches(texts: list[str | None], size: int = 1 << 22):
    """Runs of texts (null is empty) of about ``size`` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(t or "")
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    return Encoder(path)
