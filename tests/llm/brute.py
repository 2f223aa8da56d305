"""Plain Python versions of the text operators, and small hard tables."""

from __future__ import annotations

import random
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, copies string, spans string"


def prose(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices(string.ascii_lowercase[:12], k=rnd.randrange(2, 7))) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Nulls, blanks, short and long texts, copies, near copies, shared passages, repeated rows."""
    passage = prose(60, 1)
    near = prose(120, 2).split(" ")
    texts = [None, "", " \t\n ", "one", "one two three", "One TWO three", prose(400, 3), prose(400, 3), f"{prose(70, 4)} {passage} {prose(30, 5)}",
             f"{prose(20, 6)}\n{passage}", passage, "a b " * 200, "line here now\n" * 40, "x" * 3000, "# $ % " * 60, prose(20_000, 7),
             "naïve été 日本  x \x1c y", passage + " " + passage]
    for i in range(40):
        words = list(near)
        for j in range(i % 5):
            words[(7 * i + 11 * j) % len(words)] = f"w{i}x{j}"
        texts.append(" ".join(words))
    rows = [(i, t, "en", ["s1", "s2", None, "https://a.example/x"][i % 4], len(t or ""), "w", "k", "c", "s") for i, t in enumerate(texts)]
    rows.append(rows[8])
    rows.append((None, prose(80, 9), None, None, None, "w", "k", "c", "s"))
    return rows


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1)))


def jaccard_components(rows: list[tuple], n: int, pct: int) -> list[tuple]:
    """(doc_id, set size, least doc_id of the component) per row, every pair compared."""
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def without_repeats(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, words, words removed, kept words) per row; equal rows are one place."""
    first: dict[tuple, tuple] = {}
    place = lambda r, i: (-(1 << 63) if r[0] is None else r[0], i)
    cut = [WORD.findall(r[1] or "") for r in rows]
    for r, words in zip(rows, cut):
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, place(r, i)), place(r, i))
    out = []
    for r, words in zip(rows, cut):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < place(r, i):
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((r[0], len(words), len(gone), " ".join(kept)))
    return out


def counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    where: dict[tuple, list] = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for at in where.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
