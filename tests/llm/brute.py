"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def size_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Rounds of sharing: {source: size} to {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            out.update(share)
            break
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def contamination(docs, items, n=10):
    wins = {}
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        for p in range(len(w) - m + 1) if w else ():
            wins.setdefault(tuple(w[p : p + m]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if (x := wins.get(tuple(w[p : p + m]))) is not None:
                    hit |= set(range(p, p + m))
                    got |= {str(i) for i in x if i is not None}
        out.append((doc, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def pii(text):
    out = {}
    for kind, p in PII.items():
        out[kind] = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def pii_row(doc, text):
    got = pii(text)
    joined = ",".join(f"{k}:{s}:{e}" for k in PII for s, e in got[k])
    return (doc, *(len(got[k]) for k in PII), hashlib.sha256(joined.encode()).hexdigest())


def jaccard_classes(docs, threshold=0.8, n=5):
    """doc_id -> (class_id, number of links), for distinct doc_ids."""
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        sets[d] = None if t is None else (t if not w else frozenset(tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))))
    ids = list(sets)
    link = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x is None or y is None:
                continue
            if isinstance(x, str) or isinstance(y, str):
                near = x == y
            else:
                near = len(x & y) * (1 + threshold) >= threshold * (len(x) + len(y)) - 1e-9
            if near:
                link[a].add(b)
                link[b].add(a)
    out = {}
    for d in ids:
        seen, todo = {d}, [d]
        while todo:
            for x in link[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[d] = (min(seen), len(link[d]))
    return out


def normalised(line):
    return re.sub(r"[\s\x00-\x20]+", " ", line.lower(), flags=re.A).strip(" ")


def line_dedup(docs, least):
    """doc_id -> (kept text, removed spans), for distinct doc_ids: units, digests of pairs and long units, runs."""
    blanks = "".join(map(chr, range(33)))

    def cut(t):
        """Character by character: a unit ends before a word, after a line end or a picked word."""
        out, unit = [], ""
        for i, c in enumerate(t):
            if unit and c not in blanks and t[i - 1] in blanks and unit.strip(blanks):
                tail = unit[len(unit.rstrip(blanks)) :]
                w = re.split("[\\x00-\\x20]+", unit.rstrip(blanks))[-1].lower()
                if "\n" in tail or (7 * len(w) + 3 * ord(w[0]) + 5 * ord(w[-1])) % 8 == 0:
                    out.append(unit)
                    unit = ""
            elif unit and c not in blanks and t[i - 1] in blanks and "\n" in unit:
                out.append(unit)
                unit = ""
            unit += c
        return [*out, unit] if unit or not out else out

    first, units, found = {}, {}, {}
    count = lambda n: len(n.split(" ")) if n else 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        parts = cut(t) if t is not None else []
        norm = [normalised(p) for p in parts]
        units[d] = (parts, [count(n) for n in norm])
        keys = [(i, 2, (norm[i], norm[i + 1])) for i in range(len(norm) - 1)] + [(i, 1, n) for i, n in enumerate(norm) if count(n) >= least]
        found[d] = keys
        for i, _, k in sorted(keys):
            first.setdefault(k, (d, i))
    out = {}
    for d, t in docs:
        cover = {}
        for i, n, k in found[d]:
            if first[k] != (d, i):
                low = max(i, first[k][1] + n) if first[k][0] == d else i
                for p in range(low, i + n):
                    cover[p] = min(cover.get(p, first[k][0]), first[k][0])
        parts, words = units[d]
        at = [0]
        for p in parts:
            at.append(at[-1] + len(p))
        spans, run = [], []
        for p in [*sorted(cover), None]:
            if run and (p is None or p != run[-1] + 1):
                if sum(words[q] for q in run) >= least:
                    spans.append((at[run[0]], at[run[-1] + 1], cover[run[0]]))
                run = []
            run.append(p)
        kept, pos = "", 0
        for s, e, _ in spans:
            kept, pos = kept + t[pos:s], e
        out[d] = (kept + (t or "")[pos:], spans)
    return out


def crc_held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0
