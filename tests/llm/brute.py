"""Plain Python versions of the operators, over all rows and pairs."""

import hashlib
import re

import regex

from loomgraph.llm import decontaminate

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split("".join(c.lower() if c.isascii() else c for c in text or "")) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, num):
    """doc_id to (set size, component) by all pairs."""
    sets, of = {i: shingles(t, k) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in docs}


def names(text):
    """Marks names word by word: a capital inside a sentence, up to four words, none before a passage in capitals."""
    out, at, capital = [], 0, lambda w, n: regex.match(r"\p{Lu}\p{L}{%d,}" % n, w)
    while at < len(text):
        first = capital(text[at:], 1) if at > 1 and text[at - 1] == " " and (text[at - 2] in ",;" or regex.match(r"\p{Ll}", text[at - 2])) else None
        if not first:
            out.append(text[at])
            at += 1
            continue
        own, end = [first[0]], at + len(first[0])
        while len(own) < 4 and text[end : end + 1] == " " and (more := capital(text[end + 1 :], 0)):
            own.append(more[0])
            end += 1 + len(more[0])
        if regex.match(r" \p{Lu}{2}", text[end:]):
            out.append(text[at])
            at += 1
            continue
        out.append("\2a" + "".join(x + "\3" for x in own[:-1]) + own[-1] + "\3" * (4 - len(own)))
        at = end
    return "".join(out)


def template_words(text):
    text = names((text or "").replace("\2", " ").replace("\3", " "))
    text = regex.sub(r"[$€£]?\p{Nd}+(?:[.,:/]\p{Nd}+)*(%?)", " \2n\\g<0> ", text)
    text = regex.sub(f"(?i)(\2n\\S+ +)({decontaminate.UNITS})\\b", "\\1\2u\\2", text)
    return [w for w in regex.sub("[^\\p{L}\\p{N}\\p{M}\2\3.%]+|\\.(?!\\p{Nd})", " ", text.lower()).split(" ") if w]


def leaks(docs, items, n=8):
    """Set of (doc_id, item_id, n_windows, matched, exact) by comparing each window with each."""
    kind = lambda w: w[:2] if w[0] == "\2" else w
    cut = lambda w: [w[i : i + n] for i in range(max(1, len(w) - n + 1))] if w else []
    parts, out = {}, set()
    for item, text in items.items():
        own = [(i, w) for i, w in enumerate(cut(template_words(text))) if sum(x[0] != "\2" for x in w) >= min(4, len(w))]
        for i, w in own:
            parts.setdefault(tuple(map(kind, w)), []).append((item, len(cut(template_words(text))), i, w))
    for doc, text in docs.items():
        runs = {}
        for at, w in enumerate(cut(template_words(text))):
            for item, size, i, other in parts.get(tuple(map(kind, w)), []):
                ats, slots, _ = runs.setdefault((item, at - i), (set(), set(), size))
                ats.add(i)
                slots.update((b, a) for b, a in zip(other, w, strict=True) if b[0] == "\2")
        found = {}
        for (item, _), (ats, slots, size) in runs.items():
            if len({b for b, _ in slots}) == len(slots) == len({a for _, a in slots}):
                all_, same, _ = found.setdefault(item, (set(), [], size))
                all_.update(ats)
                same.append(all(a == b for a, b in slots))
        out |= {(doc, item, size, len(ats), all(same)) for item, (ats, same, size) in found.items() if len(ats) >= 6 or len(ats) / size >= 0.5}
    return out


def base_spans(text):
    """Sorted (start, kind's place, end) of fixed credential patterns."""
    text, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def said(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
