"""Small documents with copies, near copies, shared passages, nulls, ties and odd texts; and plain forms of the operators."""

import hashlib
import random

SPACE = b" \t\n\r\x0b\x0c"


def documents(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Réunion", "straße", *("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200))]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage = text(60)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 1:
            t = rows[i - 1][1]
        elif kind == 2:
            w = rows[i - 2][1].split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = f"{text(30)}\n{passage} {text(25)}"
        elif kind == 4:
            t = text(3) if i % 20 == 4 else "a b a b a b a b " * 20
        else:
            t = text(rng.randint(20, 150))
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "x" * 400), (1005, "x" * 400), (None, rows[0][1]), (1006, "A b\x1cc d"), (1007, rows[5][1].upper())]
    rows.append((1008, " ".join(text(4000) for _ in range(3))))
    return rows


SCHEMA = "doc_id bigint, text string, n_words string, chunk int, row int"


def frame(spark, rows):
    """With extra columns whose names clash with those of results and of what is made on the way."""
    return spark.createDataFrame([(i, t, "extra", 7, k) for k, (i, t) in enumerate(rows)], SCHEMA)


def removed_words(rows, k):
    """doc_id -> (words, removed, kept text's digest) by the definition; ids are unique."""
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(x for x in split if x is not None):
        w = split[i]
        for a in range(len(w) - k + 1):
            first.setdefault(tuple(w[a : a + k]), i)
    for i, w in split.items():
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), kept.decode())
    return out


def removed_bytes(rows, length):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for a in range(len(b) - length + 1):
            s = b[a : a + length]
            if s in seen:
                mask[a : a + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for p in range(len(b)) if mask[p] and (p == 0 or not mask[p - 1]))
        out.setdefault(i, []).append((len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return out


def shingle_set(t, k):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
