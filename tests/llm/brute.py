"""Plain, slow versions of the corpus operators, and tables to try them on."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, langs=None):
    """A documents table of the texts, over a few partitions."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clashing(spark, texts, ids=None):
    """Documents with columns named like those that operators add."""
    from pyspark.sql import functions as F

    extra = ["row", "fp", "root", "found", "c0", "h", "score", "spans", "n_words", "TEXT", "component_id", "text_hash"]
    return documents(spark, texts, ids).select("*", *[F.lit(f"x{i}").alias(name) for i, name in enumerate(extra)])


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(texts, items, window=13):
    """Per text: words, words hit, sorted items that occur."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners: dict = {}
    for item, text in items:
        row = word.findall(lowered(text))
        for k in range(max(1, len(row) - window + 1) if row else 0):
            owners.setdefault(tuple(row[k : k + window]), set()).add(item)
    out = []
    for text in texts:
        row, hit, found = word.findall(lowered(text)), set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(row) - n + 1):
                if own := owners.get(tuple(row[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((len(row), len(hit), sorted(found)))
    return out


def fingerprint(text, words):
    row = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(row[i : i + words]) for i in range(max(1, len(row) - words + 1) if row else 0)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(ids, prints, distance):
    """Smallest id that links of at most that many differing bits reach."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    groups: dict = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min(groups[find(i)]) for i in range(len(ids))]


def long_repeats(texts, length):
    """Per text: bytes, bytes removed, spans, SHA-256 of the rest."""
    datas = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        step = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        gone = np.cumsum(step)[: len(d)] > 0
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def identifiers(text):
    """Plain identifiers, by the patterns as they are stated."""

    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            x = int(c) * (2 if i % 2 else 1)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    def digits(x):
        return re.sub("[^0-9]", "", x)

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def vector_links(rows, similarity):
    """Per row of (id, vector, label): links, smallest id reached."""
    n = len(rows)
    unit = []
    for _, v, _ in rows:
        bad = v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v)
        unit.append(None if bad else np.array(v, float))
    linked = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            a, b = unit[i], unit[j]
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= similarity:
                    linked[i].append(j)
    out = []
    for i in range(n):
        seen, front = {i}, [i]
        while front:
            for j in linked[front.pop()]:
                if j not in seen:
                    seen.add(j)
                    front.append(j)
        out.append((len(linked[i]), min(rows[j][0] for j in seen)))
    return out
