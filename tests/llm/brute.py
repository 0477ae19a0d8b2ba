"""Plain versions of the operators, for comparison on small tables."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def roots(nodes, pairs):
    """The smallest node of each one's component."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def url_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[3] if best else default


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def simhash_components(docs, radius=4):
    prints = {d: fingerprint(t) for d, t in docs}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    return prints, roots(ids, pairs)


def vector_links(rows, bound=0.98):
    """rows of (vec_id, vector, label): links and components by cosine in double precision."""
    links, by_label = defaultdict(int), defaultdict(list)
    for i, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            by_label[label, len(v)].append((i, np.array(v, dtype=np.float64)))
    pairs = []
    for group in by_label.values():
        ids = [i for i, _ in group]
        m = np.array([v / np.linalg.norm(v) for _, v in group])
        near = m @ m.T >= bound
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            links[ids[a]] += 1
            links[ids[b]] += 1
            pairs.append((ids[a], ids[b]))
    return links, roots([i for i, _, _ in rows], pairs)


def edit_at_most_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def kept_lines(docs, min_near=20):
    """doc_id to its remaining text."""
    seen, out = [], {}
    exact = set()
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        if text is None:
            out[doc_id] = None
            continue
        kept = []
        for line in text.split("\n"):
            own = line.strip(" \t\r\x0b\f")
            near = len(own) >= min_near and any(len(x) >= min_near and edit_at_most_one(own, x) for x in seen if abs(len(x) - len(own)) < 2)
            if not own or not (own in exact or near):
                kept.append(line)
            if own and own not in exact:
                exact.add(own)
                seen.append(own)
        out[doc_id] = "\n".join(kept)
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Water filling, round by round: sizes by source in order."""
    target, open_ones = dict.fromkeys(sizes, 0.0), {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    left = share * sum(sizes.values())
    while open_ones and left > 1e-9:
        whole = sum(open_ones.values())
        part = {s: left * w / whole for s, w in open_ones.items()}
        capped = [s for s in open_ones if part[s] >= epochs * sizes[s]]
        if not capped:
            target.update(part)
            break
        for s in capped:
            target[s] = epochs * sizes[s]
            left -= target[s]
            del open_ones[s]
    return target


def languages(docs, parts=4, held=2, quota=25_000):
    """{place in docs: (lang_pred, score)} of (doc_id, text, lang) rows by word-first backoff over plain dictionaries."""
    words = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    pieces = lambda word, n: [f"<{word}>"[i : i + n] for i in range(len(word) + 3 - n)]
    counts = {}  # (kind, lang): {gram: n}
    for doc_id, text, lang in docs:
        if text is None or lang is None or zlib.crc32(str("" if doc_id is None else doc_id).encode()) % parts == held:
            continue
        for kind in (0, 1):
            own = counts.setdefault((kind, lang), {})
            for word in words(text):
                for gram in [word] if kind == 0 else [g for n in (1, 2, 3, 4) for g in pieces(word, n)]:
                    own[gram] = own.get(gram, 0) + 1
    langs = sorted({lang for _, lang in counts})
    known = (set(), set())
    for (kind, _), own in counts.items():
        for least in sorted(set(own.values())):
            chosen = {g for g, n in own.items() if n >= least}
            if len(chosen) <= quota:
                known[kind].update(chosen)
                break

    def log(kind, gram, lang):
        own = counts[kind, lang]
        return math.log((own.get(gram, 0) + 0.5) / (sum(own.values()) + 1))

    def word_score(word, lang):
        if word in known[0]:
            return log(0, word, lang)
        for n in (4, 3, 2, 1):
            found = [g for g in pieces(word, n) if g in known[1]]
            if found:
                return sum(log(1, g, lang) for g in found) / len(found)
        return log(1, None, lang)

    result = {}
    for at, (_, text, _) in enumerate(docs):
        total = {lang: sum(word_score(w, lang) for w in words(text or "")) for lang in langs}
        if not langs or not any(c.isalpha() for c in text or ""):
            result[at] = ("und", 0.0)
            continue
        best = max(langs, key=lambda lang: total[lang])
        result[at] = (best, 1 / sum(math.exp(total[lang] - total[best]) for lang in langs))
    return result
