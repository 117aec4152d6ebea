"""Plain versions that the operators are compared with."""


def repeated_bytes(rows, window=100):
    """``{id: (removed runs, kept bytes)}``; texts as bytes, ids in any order."""
    first, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        cover = bytearray(len(text))
        for p in range(len(text) - window + 1):
            piece = text[p : p + window]
            if first.setdefault(piece, (key, p)) != (key, p):
                cover[p : p + window] = b"\x01" * window
        spans, at = [], 0
        while (at := cover.find(1, at)) >= 0:
            end = cover.find(0, at)
            end = len(text) if end < 0 else end
            spans += [at, end]
            at = end
        out[key] = spans, bytes(b for b, c in zip(text, cover) if not c)
    return out


def similarity(rows, size=5, threshold=0.8):
    """``{id: (class, links)}`` by comparing all texts that share a shingle."""
    import re

    sets = {}
    for key, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
        found = re.findall(rb"[0-9a-z\x80-\xff]+", low)
        n = len(found)
        sets[key] = frozenset(tuple(found[i : i + size]) for i in range(n - size + 1)) if n >= size else frozenset([tuple(found)] if n else [])
    holders = {}
    for key, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(key)
    links = {key: set() for key in sets}
    for key, s in sets.items():
        common = {}
        for g in s:
            for other in holders[g]:
                if other != key:
                    common[other] = common.get(other, 0) + 1
        for other, c in common.items():
            if c >= threshold * (len(s) + len(sets[other]) - c) - 1e-9:
                links[key].add(other)
    root = {}
    for key in sorted(sets):
        if key in root:
            continue
        todo = [key]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = key
                todo += links[k]
    return {key: (root[key], len(links[key])) for key in sets}
