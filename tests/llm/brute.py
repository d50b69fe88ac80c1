"""Plain versions of the operators, to hold results against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def link(rows, percent=80):
    """{index: (n, smallest id)} for rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    first, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        if s:
            j = first.setdefault(s, i)
            root[find(i)] = find(j)
    posted = {}
    kinds = list(first.items())
    for s, i in kinds:
        met = {j for x in s for j in posted.get(x, ())}
        for j in met:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for x in s:
            posted.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def repeats(rows, width=100):
    """[(doc_id, n_bytes, spans)] for rows (doc_id, text) in corpus order."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                hit[i : i + width] = b"\1" * width
            else:
                seen.add(w)
        spans, i = [], 0
        while i < len(b):
            if hit[i]:
                j = i
                while j < len(b) and hit[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((d, len(b), spans, bytes(x for x, h in zip(b, hit) if not h)))
    return out


def spelling(docs, least=5, often=3, damaged=97):
    """{word: (form, root, n, n_near, form_n)} of rows (doc_id, text)."""
    import zlib
    from collections import Counter

    total = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if damaged and h % damaged == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    words = {w: c for w, c in total.items() if len(w) >= least and c >= often}
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
            if (cut := w[:k] + w[k + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def url_parts(url):
    """Host and path."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules, default="allow"):
    """(host, path, rule, verdict) by rules (host, path, verdict), each tried."""
    host, path = url_parts(url)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of a fill-in-middle text."""
    import hashlib

    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"
