"""Small inputs and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, ids=None, partitions=3):
    """A documents table; ``texts`` may hold None."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def repetitive_texts(seed: int, n: int = 120) -> list[str | None]:
    """Texts that share passages, with copies, empties, nulls, ties and odd white space."""
    r = random.Random(seed)
    words = ["a", "b", "the", "größe", "x1", "naïve", "zz", "Ω", "end."]
    passages = [[r.choice(words) for _ in range(r.randint(5, 60))] for _ in range(12)]
    out: list[str | None] = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.05:
            out.append(r.choice([None, "", "  \n", "one"]))
        elif kind < 0.15 and out:
            out.append(r.choice(out))
        else:
            tokens = []
            for _ in range(r.randint(1, 5)):
                if r.random() < 0.6:
                    p = r.choice(passages)
                    a = r.randint(0, len(p) - 1)
                    tokens += p[a:r.randint(a, len(p))]
                else:
                    tokens += [r.choice(words) + str(r.randint(0, 50)) for _ in range(r.randint(1, 40))]
            out.append("".join(t + r.choice([" ", " ", "\n", "\t ", "  "]) for t in tokens))
    out.append("ab" * 400)  # periodic
    out.append("a " * 300)
    out.append("ab" * 350)
    return out


def repeats(texts, ids, length, symbols):
    """Removed-symbol mask of each text, judged window by window."""
    first: dict = {}
    parts = [symbols(t or "") for t in texts]
    for i, p in zip(ids, parts):
        if i is not None:
            for k in range(len(p) - length + 1):
                w = tuple(p[k:k + length])
                first[w] = min(first.get(w, i), i)
    masks = []
    for i, p in zip(ids, parts):
        mask = bytearray(len(p))
        for k in range(len(p) - length + 1):
            if i is not None and first[tuple(p[k:k + length])] < i:
                mask[k:k + length] = b"\1" * length
        masks.append(bytes(mask))
    return parts, masks


def space_words(text: str) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
