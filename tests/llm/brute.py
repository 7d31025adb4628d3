"""Plain restatements of what the operators return, one document after the other."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

from barloom.llm import html_extract

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def secrets(text):
    text, found = text or "", []
    found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    n = Counter(k for _, _, k, _ in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(spans.encode()).hexdigest(), spans


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def contamination(docs, items, window=13):
    """docs, items: lists of (id, text)."""
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            grams[tuple(w[k : k + n])].add(str(item))
    lengths = sorted({len(g) for g in grams})
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        ids = sorted(found)
        yield doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def near_items(docs, items, window=13):
    """How many items have the two rarest terms of some window within `window` words in each document."""
    places = [defaultdict(list) for _ in docs]
    counts = Counter()
    for (_, text), at in zip(docs, places, strict=True):
        for i, w in enumerate(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")):
            at[w.lower()].append(i)
            counts[w.lower()] += 1
    found = Counter()
    for _, text in items:
        w = [x.lower() for x in words(text)]
        n, rare = min(window, len(w)), set()
        for k in range(len(w) - n + 1) if w else ():
            ranked = sorted((counts[x], x, i) for i, x in enumerate(w[k : k + n]))
            if ranked[0][0] and len(ranked) > 1:
                rare.add((ranked[0][1], ranked[1][1]))
        for k, at in enumerate(places):
            found[k] += any(0 < abs(i - j) <= window for a, b in rare for i in at[a] for j in at[b])
    return [found[k] for k in range(len(docs))]


def shingles(text, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs, n=2):
    sets = {d: shingles(t, n) for d, t in docs}
    holders, root = defaultdict(list), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for a, s in sets.items():
        for b, both in Counter(b for x in s for b in holders[x] if b < a).items():
            if 100 * both >= 80 * (len(s) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def crc(text):
    return zlib.crc32((text or "").encode())


def without_boilerplate(docs, min_sites=10):
    """docs: (id, text, site), ids distinct. Lines of blanks alone are no lines."""
    blank = " \t\r\x0b\x0c\u00a0\u3000"
    sites, first = defaultdict(set), {}
    for d, text, site in sorted(docs, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip(" ")
            if line.strip(blank):
                if site is not None:
                    sites[line].add(site)
                first.setdefault(line, (d, i))
    out = {}
    for d, text, _ in docs:
        kept, gone = [], 0
        for i, line in enumerate((text or "").split("\n")):
            name = line.strip(" ")
            if name.strip(blank) and len(sites[name]) >= min_sites and first[name] != (d, i):
                gone += 1
            else:
                kept.append(line)
        out[d] = (None if text is None else "\n".join(kept), gone)
    return out


TELLING = """ad ads advert adverts advertisement advertisements adslot adsense banner breadcrumb breadcrumbs cookie cookies consent copyright gdpr dialog footer foot header legal masthead menu menubar modal nav
navbar navigation newsletter notice notices alert pager pagination popup promo promotion related recommended share sharing sidebar skip social sponsor sponsored subscribe tags toolbar topbar widget complementary contentinfo search""".split()
COMMENTS = "comment comments commentlist commentary reply replies respond responses discussion disqus".split()
OF_COMMENTS = "area block body box container content form item list section thread text wrap wrapper reader readers user".split()
APART = "nav aside footer script style noscript template svg button select option textarea iframe object canvas dialog menu head title input audio video map search".split()
STRUCTURE = "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption section header hgroup".split()


class _Tree(HTMLParser):
    """Text nodes of a page, each with its whole list of open elements (number, tag, weight, level, apart)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.n, self.block = [], [], 0, 0

    def _end_block(self):
        self.block += 1

    def handle_starttag(self, tag, attrs):
        h = html_extract
        if tag in h.BLOCK:
            self._end_block()
            while self.open and self.open[-1][1] not in h.BLOCK:
                self.open.pop()
            own, until = h.CLOSES.get(tag, h.CLOSES["p"])
            while True:
                hit = None
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][1] in until or (own == ("p",) and self.open[i][1] in h.BLOCK and self.open[i][1] != "p"):
                        break
                    if self.open[i][1] in own:
                        hit = i
                        if own == ("p",):
                            break
                if hit is None:
                    break
                del self.open[hit:]
            while self.open and self.open[-1][1] not in h.BLOCK:
                self.open.pop()
        if tag == "br":
            self.handle_data(" ")
        if tag in h.VOID:
            return
        self.n += 1
        named = {k: v or "" for k, v in attrs}
        weight, deeper = 1.0, tag == "form"
        if tag not in ("html", "body", "article", "main"):
            for token in " ".join(named.get(k, "") for k in ("class", "role", *(["id"] if tag in "div ul ol table form span td".split() else []))).split():
                parts = [x.lower() for x in re.findall("[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+", token)]
                good = [x for x in parts if x in TELLING]
                if good and len(good) >= len(parts) - len(good):
                    weight = 0.5
                deeper = deeper or (any(x in COMMENTS for x in parts) and all(x in COMMENTS or x in OF_COMMENTS for x in parts))
        inside = any(t in ("article", "main") for _, t, *_ in self.open)
        apart = tag in APART or (tag == "header" and not inside) or "hidden" in named
        self.open.append((self.n, tag, weight, int(deeper), apart))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self._end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][1] == tag:
                del self.open[i:]
                return
            if tag not in html_extract.BLOCK and self.open[i][1] in html_extract.BLOCK:
                return

    def handle_data(self, data):
        if not any(x[-1] for x in self.open):
            self.texts.append((self.block, tuple(self.open), data))


def main_text(page):
    """The definition of html_extract.main_text(), with every sum taken anew for every block."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    groups = defaultdict(list)
    for block, chain, data in tree.texts:
        if block in groups or data.strip():
            groups[block].append((chain, data))
    every = []  # chain of the block's element, text, own length, marks, linked length
    for parts in groups.values():
        chain = parts[0][0]
        while chain and chain[-1][1] not in html_extract.BLOCK:
            chain = chain[:-1]
        linked = [any(t == "a" for _, t, *_ in c) for c, _ in parts]
        own = sum(len(d.strip()) for (_, d), link in zip(parts, linked, strict=True) if not link)
        marks = sum(len(re.findall(r"[.,;:!?…·。，、；：！？¿¡]", d)) for (_, d), link in zip(parts, linked, strict=True) if not link)
        every.append((chain, re.sub(r"\s+", " ", "".join(d for _, d in parts)).strip(), own, marks, sum(len(d.strip()) for (_, d), link in zip(parts, linked, strict=True) if link)))

    def level(chain):
        return sum(x[3] for x in chain)

    def path(chain):
        return tuple(x[1:4] for x in chain)

    def weight(chain):
        return math.prod(x[2] for x in chain)

    whole = sum(own for _, _, own, _, _ in every)
    levels = [k for k in {level(c) for c, *_ in every} if 0 < (n := sum(own for c, _, own, _, _ in every if level(c) == k)) and n >= whole / 100]
    found = [x for x in every if level(x[0]) <= min(levels, default=0) and (x[2] or x[4])]
    if not found:
        return ""
    title = re.search(r"(?i)<title(?:\s[^>]*)?>([^<]*)", page)
    title = " ".join(html.unescape(title[1]).lower().split()) if title else ""

    def says(text):
        return bool(text and title) and any(a.startswith(b) or a.endswith(b) for a, b in ((text.lower(), title), (title, text.lower())))

    heads = [i for i, (chain, text, _, _, linked) in enumerate(found) if chain and chain[-1][1] in ("h1", "h2") and not linked]
    homes = {path(found[i][0][:-1]) for i in heads if says(found[i][1])}
    texts, marks, around, marked = [], [], [], []
    for chain, *_ in found:
        same = [x for x in found if path(x[0]) == path(chain)]
        beside = [x for x in found if bool(x[0]) == bool(chain) and path(x[0][:-1]) == path(chain[:-1])]
        factor = 0.02 if homes and (not chain or path(chain[:-1]) not in homes) else 1
        texts.append(sum(x[2] for x in same))
        marks.append(1 + sum(x[3] for x in same))
        around.append(factor * sum(x[2] for x in beside))
        marked.append(1 + factor * sum(x[3] for x in beside))

    def smooth(v, i):
        weights = [math.exp(-2 * k * k) for k in range(-2, 3)]
        return sum(w * v[min(max(i + k, 0), len(v) - 1)] for w, k in zip(weights, range(-2, 3), strict=True)) / sum(weights)

    fused = [math.prod(smooth(v, i) for v in (texts, marks, around, marked)) for i in range(len(found))]
    values = []
    for chain, *_ in found:
        same = [k for k, x in enumerate(found) if path(x[0]) == path(chain)]
        linked, own = sum(found[k][4] for k in same), sum(found[k][2] for k in same)
        value = sum(fused[k] for k in same) / len(same) * (0 if linked > own else 1 - linked / (own + linked))
        values.append(value * weight(chain) * (2 if any(t in ("article", "main") for _, t, *_ in chain) else 1))
    chosen = [v > 0.15 * max(values) for v in values]
    blocks = [[0, *(x[0] for x in chain if x[1] in html_extract.BLOCK)] for chain, *_ in found]
    tags = [["", *(x[1] for x in chain if x[1] in html_extract.BLOCK)] for chain, *_ in found]
    spans = defaultdict(list)
    for i, c in enumerate(chosen):
        for number in blocks[i][-2:] if c else ():
            spans[number].append(i)
    first = [i for i in heads if found[i][0][-1][1] == "h1"]
    heading = next((i for i in heads if says(found[i][1])), first[0] if len(first) == 1 else None)
    top = max(weight(chain) for chain, *_ in found)
    out = []
    for i, (chain, text, own, _, linked) in enumerate(found):
        belongs = any(s[0] < i < s[-1] for s in spans.values())
        for number, tag in zip(blocks[i][::-1], tags[i][::-1], strict=True):
            belongs = belongs or number in spans
            if tag not in STRUCTURE:
                break
        article = any(t in ("article", "main") for _, t, *_ in chain)
        if chosen[i] or i == heading or (belongs and weight(chain) == top and (article or linked <= own)):
            out.append(text)
    return "\n".join(out)
