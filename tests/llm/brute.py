"""Plain versions of the contracts, for comparison on small tables."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations


def near_duplicates(rows, k=2, percent=80):
    """{doc_id: (set size, component)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeated_bytes(rows, width=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - width + 1):
            w = data[p : p + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        rest = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, item ids)}."""
    def words(text):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    windows = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + window]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    met |= found
        out[i] = (len(w), len(hit), sorted(met))
    return out


def url_verdicts(rows, rules, lexicon, seeds):
    """{page_id: (host, path, rule, verdict)} of (page_id, url) rows: rules, then Viterbi splits and naive Bayes over all rows."""
    pages = {}
    for i, url in rows:
        _, found, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if found else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
        pages[i] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path
    n_host, n_path = Counter(h for h, _ in pages.values()), Counter(p for _, p in pages.values())
    words = Counter(lexicon)
    for h, n in n_host.items():
        for part in h.split("."):
            for w in re.findall("[a-z]+", part) if "-" in part else ():
                words[w] += n
    for p, n in n_path.items():
        for w in re.findall("[a-z]+", p.lower()):
            words[w] += n
    words = {w: n for w, n in words.items() if 2 <= len(w) <= 24}
    total = sum(words.values())

    def split(part):
        ways = {0: (0.0, [])}
        for end in range(1, len(part) + 1):
            options = []
            for start in range(end):
                piece = part[start:end]
                cost = math.log10(words[piece] / total) if piece in words else math.log10(10.0 / total) - 0.8 * len(piece)
                options.append((ways[start][0] + cost, start))
            cost, start = max(options)
            ways[end] = cost, [*ways[start][1], part[start:end]]
        return ways[len(part)][1]

    own = {h: [w for part in re.findall("[a-z]{1,63}|[^a-z.-]{1,63}", h) for w in split(part)] for h in n_host}
    of_path = {p: ["#" if t[0].isdigit() else t for t in re.findall("[a-z]+|[0-9]+", p.lower())] for p in n_path}
    block = {h: any(w in seeds for w in ws) for h, ws in own.items()}
    seen = {True: Counter(), False: Counter()}
    for h, p in pages.values():
        seen[block[h]].update(own[h] + of_path[p])
    kinds = len(seen[True] | seen[False])
    sums, prior = ({c: sum(x[c].values()) for c in x} for x in (seen, {c: Counter({h: n for h, n in n_host.items() if block[h] == c}) for c in (True, False)}))
    odds = lambda t: math.log((seen[True][t] + 1) / (sums[True] + kinds + 1)) - math.log((seen[False][t] + 1) / (sums[False] + kinds + 1))
    out = {}
    for i, (h, p) in pages.items():
        fits = [(r, v) for r, v in rules if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        score = math.log((prior[True] + 1) / (prior[False] + 1)) + sum(map(odds, own[h])) + sum(map(odds, of_path[p]))
        out[i] = h, p, rule, verdict or ("block" if score > 0 else "allow")
    return out


def fingerprint(samples, frame=512, hop=256, bands=((1, 16), (16, 64), (64, 257))):
    """Codes of paired spectral peaks of 8-bit samples, frame by frame."""
    import numpy as np

    x = [float(s) - 128 for s in samples]
    while len(x) < frame or (len(x) - frame) % hop:
        x.append(x[-1])
    window = np.hanning(frame)
    power = []
    for at in range(0, len(x) - frame + 1, hop):
        part = np.array(x[at : at + frame])
        power.append(np.abs(np.fft.rfft((part - part.mean()) * window)) ** 2)
    tops = [[max(range(lo, hi), key=lambda b: p[b]) for lo, hi in bands] for p in power]
    level = lambda t, b: power[t][tops[t][b]] if 0 <= t < len(power) else 0.0
    peaks = [(t, tops[t][b]) for t in range(len(power)) for b in range(len(bands)) if level(t, b) > level(t - 1, b) and level(t, b) >= level(t + 1, b) and level(t, b) > 1e-3]
    return sorted((t << 32) | (f << 18) | (g << 8) | (u - t) for k in (1, 2) for (t, f), (u, g) in zip(peaks, peaks[k:]) if u - t <= 63)


def fill_in_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def vector_codes(rows, parts=4, entries=256, rounds=4):
    """[(id, label, code, error)] and the codebooks of (id, vector, label) rows, row by row in whole numbers."""
    kept = []
    for i, v, label in rows:
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts if kept else 0
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])])
        books = new
    out = []
    for i, v, label in kept:
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return out, books


def quality_scores(docs, labels, per_row=9, dimensions=48):
    """{doc_id: score} by all labelled rows' neighbours, document by document."""
    import zlib

    import numpy as np

    def shares(text):
        words, lines, out = text.split(), text.split("\n"), Counter()
        for w in words:
            kind = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w)
            out["s" + re.sub(r"(.)\1+", r"\1+", kind)] += 1 / len(words)
            out["w" + w.lower().strip(".,;:!?|#$%&*()[]{}<>\"'")] += 1 / len(words)
        for step in (1, 2, 3):
            if again := sum(a == b for a, b in zip(words, words[step:])):
                out[f"again {step}"] = again / len(words)
        if words and len(set(lines)) < len(lines):
            out["line again"] = 1 - len(set(lines)) / len(lines)
        return out

    of = {i: shares(t or "") for i, t in docs}
    label = {i: q for i, q in labels if q is not None and zlib.crc32(str(i).encode()) % 5 and i in of}
    ids = sorted(i for i in label if of[i])
    seen = Counter(t for i in ids for t in of[i])
    chosen = [t for t, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= 4][:2048]
    matrix = np.array([[math.sqrt(of[i][t]) for t in chosen] for i in ids])
    part = matrix / matrix.sum(0)
    weight = np.maximum(0.05, 1 + (part * np.log(np.where(part > 0, part, 1))).sum(0) / math.log(len(ids)))
    _, _, base = np.linalg.svd(matrix * weight, full_matrices=False)
    base = base[:dimensions] * weight
    unit = lambda v: v / max(1e-12, np.linalg.norm(v))
    known = [(unit(base @ row), label[i]) for i, row in zip(ids, matrix)]
    prior = sum(label.values()) / len(label)
    out = {}
    for i, t in of.items():
        row = np.array([math.sqrt(t[x]) for x in chosen])
        if not row.any():
            out[i] = prior
            continue
        near = sorted(((max(0.0, round(float(unit(base @ row) @ v), 6)), q) for v, q in known), reverse=True)
        near = [x for x in near if x[0] >= near[min(per_row, len(near)) - 1][0]]
        out[i] = (sum(c * q for c, q in near) + 1e-3 * prior) / (sum(c for c, _ in near) + 1e-3)
    return out
