"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + k: 97 + k for k in range(26)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def jaccard(rows, width, percent):
    """doc_id -> (set size, component) of rows with distinct ids."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def language_model(train, texts, order=3, discount=0.75):
    """(tokens, base, score) of each text."""
    tokens = lambda t: [*words(t), None]
    grams = [Counter() for _ in range(order)]
    for t in map(tokens, train):
        for k in range(order):
            grams[k].update(tuple(t[i : i + k + 1]) for i in range(len(t) - k))
    n, v = sum(grams[0].values()), len(grams[0])
    total, successors = Counter(), defaultdict(int)
    for g in grams[1:]:
        for key, c in g.items():
            total[key[:-1]] += c
            successors[key[:-1]] += 1
    out = []
    for t in map(tokens, texts):
        base = score = 0.0
        for i, w in enumerate(t):
            p = (grams[0][w,] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(1, min(order, i + 1)):
                g = tuple(t[i - k : i + 1])
                if total[g[:-1]]:
                    p = max(grams[k][g] - discount, 0) / total[g[:-1]] + discount * successors[g[:-1]] / total[g[:-1]] * p
            score += math.log10(p)
        out.append((len(t), base, score))
    return out


def kept_lines(rows):
    """doc_id -> text left, None if nothing is; of rows with distinct ids."""

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) < 5 or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    seen, out = [], {}
    for d, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if text is None:
            out[d] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = WORD.findall(line)
            if not w:
                kept.append(line)
                continue
            if not any(w == s or near(w, s) for s in seen):
                kept.append(line)
            seen.append(w)
        left = "\n".join(kept)
        out[d] = left if len(kept) == len(text.split("\n")) or left.strip(" \t\n\r\x0b\x0c") else None
    return out


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    """Base spans as text, by the patterns alone."""
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def alignment(texts, encode_a, encode_b):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text; encoders give (id, bytes) of each token."""
    made = []
    for t in texts:
        a = encode_a(t) if t else []
        b = encode_b(t) if t else []
        whole = b" " + (t or "").encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            made.append(([], [], [], []))
            continue
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, x in side:
                at += len(x)
                own.append(at)
            ends.append(own)
        links = [(a[i][0], b[j][0]) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y] if len(t) < 400 else [(a[i][0], b[ends[1].index(x)][0]) for i, x in enumerate(ends[0]) if x in set(ends[1])]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            left = [str(a[k][0]) for k in range(i, len(a)) if ends[0][k] <= cut]
            right = [str(b[k][0]) for k in range(j, len(b)) if ends[1][k] <= cut]
            i, j = i + len(left), j + len(right)
            groups.append(",".join(left) + "|" + ",".join(right))
        made.append((a, b, groups, links))
    count = Counter(x for *_, links in made for x in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), ";".join(g)) for a, b, g, x in made]


def _chain(values, seed=42):
    """Spark's xxhash64 of a sequence of longs."""
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def lexicon_fingerprints(texts, every, band, densities, of_each, seen):
    """(fingerprints, likeness) over a lexicon from ``every``; likeness takes two of the texts' places."""
    terms = lambda t: {x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x}
    df = Counter(x for t in every for x in terms(t))
    words = {x for x, n in df.items() if band[0] <= math.log(len(every) / n) < band[1]}
    sizes = [d for d in densities for _ in range(of_each)]
    codes = {}
    for x in words:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        mask = 1 << len(sizes)
        for k, d in enumerate(sizes):
            v = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), _chain([h]))
            mask |= (v % (1 << d) == 0) << k
        code = (h << (len(sizes) + 1) | mask) & (1 << 64) - 1
        codes[x] = code - (1 << 64) if code >> 63 else code
    made = []
    for t in texts:
        own = sorted(codes[x] for x in terms(t) & words)
        made.append([_chain(c) & 0xFFFFFFFF if (c := [c for c in own if c >> k & 1]) else None for k in range(len(sizes) + 1)] if own else None)
    whole = [xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts]
    printed = ["".join("." * 8 if h is None else f"{h:08x}" for h in m) if m else f"={w:016x}" for m, w in zip(made, whole, strict=True)]

    def likeness(a, b):
        if made[a] is None and made[b] is None:
            return float(whole[a] == whole[b])
        if made[a] is None or made[b] is None:
            return 0.0
        both = [(x, y) for x, y in zip(made[a], made[b], strict=True) if x is not None or y is not None][:seen]
        return sum(x == y for x, y in both) / len(both)

    return printed, likeness


def crc_mpeg(data):
    c = 0xFFFFFFFF
    for byte in data:
        for k in range(7, -1, -1):
            top = c >> 31 ^ byte >> k & 1
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return c


def transport(media):
    """(payload, times, points, continuity errors, program, type) of the first stream, packet by packet; damaged streams are not for it."""
    last, buffers, seen_tables = {}, {}, {}
    programs, streams, chosen = {}, {}, None
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    # program tables first, from the whole stream
    for wanted in ("pat", "pmt"):
        buffers, last = {}, {}
        for p in packets:
            pid = (p[1] & 31) << 8 | p[2]
            if p[1] & 0x80 or not p[3] & 0x10 or (wanted == "pat") != (pid == 0) or (wanted == "pmt" and pid not in programs.values()):
                continue
            if last.get(pid) == p:
                continue
            last[pid] = p
            data = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
            if p[1] & 0x40:
                if pid in buffers:
                    buffers[pid] += data[1 : 1 + data[0]]
                    seen_tables.setdefault(pid, []).append(buffers[pid])
                buffers[pid] = data[1 + data[0] :]
            elif pid in buffers:
                buffers[pid] += data
        for pid, rest in buffers.items():
            for held in [*seen_tables.get(pid, []), rest]:
                while len(held) > 3 and held[0] != 0xFF:
                    size = 3 + (held[1] % 16 * 256 + held[2])
                    body, held = held[:size], held[size:]
                    if len(body) < size or crc_mpeg(body):
                        continue
                    if wanted == "pat":
                        for k in range(8, size - 4, 4):
                            if body[k] or body[k + 1]:
                                programs.setdefault(body[k] * 256 + body[k + 1], body[k + 2] % 32 * 256 + body[k + 3])
                    else:
                        k = 12 + body[10] % 16 * 256 + body[11]
                        while k < size - 4:
                            streams.setdefault(body[3] * 256 + body[4], {}).setdefault(body[k + 1] % 32 * 256 + body[k + 2], body[k])
                            k += 5 + body[k + 3] % 16 * 256 + body[k + 4]
        seen_tables = {}
    program = next(n for n in programs if n in streams)
    chosen, kind = next(iter(streams[program].items()))
    units, marks, counter, before, errors = [], [], None, None, 0
    waiting = []
    for number, p in enumerate(packets):
        if p[1] & 0x80 or (p[1] & 31) << 8 | p[2] != chosen or not p[3] & 0x30:
            continue
        adapted = p[3] & 0x20 and p[4]
        data = (p[5 + p[4] :] if p[3] & 0x20 else p[4:]) if p[3] & 0x10 else None
        if data is not None and counter is not None and p[3] & 15 == counter and data == before:
            continue
        if adapted and p[5] & 0x40:
            waiting.append(number)
        if data is None:
            continue
        if counter is not None and p[3] & 15 != (counter + 1) % 16 and not (adapted and p[5] & 0x80):
            errors += 1
        counter, before = p[3] & 15, data
        if p[1] & 0x40:
            units.append(b"")
            marks.append(waiting[0] if waiting else None)
            waiting = []
        if units:
            units[-1] += data
    payload, times, points = b"", [], []
    for unit, mark in zip(units, marks, strict=True):
        size, at = unit[4] * 256 + unit[5], 6
        if unit[3] not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):
            at = 9 + unit[8]
            if unit[7] & 0x80:
                bits = "".join(f"{x:08b}" for x in unit[9:14])
                times.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
                if mark is not None:
                    points.append((mark, times[-1]))
        payload += unit[at : 6 + size if size else len(unit)]
    return payload, times, points, errors, program, kind
