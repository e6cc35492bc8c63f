"""Brute-force versions that the tests share."""

import re

import xxhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows):
    """{id: (fingerprint, least id of its component)} for links at two or fewer bits."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return {doc: (fp, least[root(i)]) for i, (doc, fp) in enumerate(rows)}


def test_classes_of_a_small_case():
    assert classes([(5, 0b0), (3, 0b11), (9, 0b1111), (1, 0b1111100)]) == {5: (0, 3), 3: (3, 3), 9: (15, 3), 1: (124, 1)}
