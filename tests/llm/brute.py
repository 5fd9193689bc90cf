"""Brute-force versions of the operators, in plain Python over small tables."""

from __future__ import annotations

import collections
import hashlib
import html.parser
import re

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(n - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


class Union:
    def __init__(self):
        self.up = {}

    def root(self, a):
        while self.up.get(a, a) != a:
            a = self.up[a]
        return a

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near_documents(docs):
    """{id: (n_shingles, component)}; every pair is compared."""
    sets = {i: shingles(t) for i, t in docs}
    u, ids = Union(), sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                u.link(i, j)
    return {i: (len(sets[i]), u.root(i)) for i in ids}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def spelled(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mix_targets(sizes, weights=(5, 2, 1)):
    """{source: target} from {source: size}, None last: reshare the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        rate = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target | {s: rate * weight[s] for s in free}


def near_vectors(rows):
    """{id: (links, component)} from (id, vector, label)."""
    import numpy as np

    usable = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    u, links = Union(), collections.Counter()
    for k, (i, v, g) in enumerate(usable):
        for j, w, h in usable[k + 1 :]:
            if g == h and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                links[i] += 1
                links[j] += 1
                u.link(i, j)
    return {i: (links[i], u.root(i)) for i, _, _ in rows}


class _Tree(html.parser.HTMLParser):
    """A page as nested lists [tag, attributes, children]; paragraphs, items and cells end where HTML ends them."""

    ENDS = {"p": "p h1 h2 h3 h4 h5 h6 ul ol li div section article table tr td th aside footer nav form header blockquote", "li": "li", "td": "td th tr", "th": "td th tr", "tr": "tr"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["html", {}, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        while tag in self.ENDS.get(self.open[-1][0], "").split():
            self.open.pop()
        node = [tag, dict(reversed(attrs)), []]
        self.open[-1][2].append(node)
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


INLINE = "a b i em strong span code sub sup small math mi mo mn u br img".split()
GONE = "script style nav footer aside form button select head svg annotation".split()


def article_text(page):
    """The article's blocks of a page whose text stands in one <article>; a plain walk over its tree."""
    out, line = [], []

    def end():
        words = " ".join("".join(line).split())
        line.clear()
        if words:
            out.append(words)

    def walk(node):
        for child in node[2]:
            if isinstance(child, str):
                line.append(child)
            elif child[0] == "br":
                line.append(" ")
            elif child[0] in INLINE:
                walk(child)
            elif child[0] not in GONE and "hidden" not in child[1]:
                end()
                walk(child)
                end()

    def find(node):
        if node[0] == "article":
            return node
        return next((x for c in node[2] if not isinstance(c, str) and (x := find(c))), None)

    article = find(_Tree(page or "").root)
    if article:
        walk(article)
        end()
    return "\n\n".join(out)
