"""Small tables with the awkward cases, and plain-Python restatements of the operators."""

from __future__ import annotations

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use within themselves, as extra columns.
CLASHES = ("row", "d", "t", "size", "language", "copies", "taken", "kept", "_m", "runs", "found", "score")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def prose(rng: random.Random, n: int, pool: int = 300) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def awkward_texts() -> list[str | None]:
    """Null, empty, blank, short, long, repeated, overlapping and periodic texts."""
    rng = random.Random(3)
    base, shared = prose(rng, 400), prose(rng, 60)
    near = base.split()
    near[200] = "changed"
    out: list[str | None] = [None, "", " \t\n", "one", "Ünï cödé 你好", base, base, " ".join(near), "%% ## 12 34", None]
    out += [f"{prose(rng, 30)} {shared} {prose(rng, 20)}" for _ in range(12)]
    out += ["spam " * 500, "spam " * 90, "ab" * 700, prose(rng, 20_000, 5000), shared, shared + "  " + shared, "a\x00b " * 40]
    out += [prose(rng, rng.randrange(1, 120)) for _ in range(20)]
    return out


def documents(spark, texts=None, **extra):
    texts = awkward_texts() if texts is None else texts
    rows = [(i * 7 % 1009, t, ("en", "de", None)[i % 3], (None, "s2", "s10", "S", "é")[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES} | {"odd name, here": F.lit(1)})


def without_repeats(texts: dict[int, list | bytes], window: int) -> dict[int, tuple[int, int, int, list | bytes]]:
    """(units, removed, spans, kept) by id, ids in order."""
    seen, out = set(), {}
    for i in sorted(texts):
        u = texts[i]
        gone = [False] * len(u)
        for s in range(len(u) - window + 1):
            w = bytes(u[s : s + window]) if isinstance(u, bytes) else tuple(u[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(u), sum(gone), spans, bytes(kept) if isinstance(u, bytes) else kept)
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def components(links: dict[int, set[int]]) -> dict[int, int]:
    root: dict[int, int] = {}
    for start in sorted(links):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += links[x]
    return root
