"""URL filters: glob rules as one bit-parallel automaton.

All rules are packed, end to end, into the bits of 64-bit words. A character of the canonical URL moves every
rule one step at once (Shift-And): state = (state << 1 | starts) & mask[character], with bits that stay where a rule has `*`.
The state is a row of words for each URL, so a batch of URLs moves together. Nothing but the URL's length and the
number of rules sets the cost.

The canonical URL is "." + host + 0xFF + path in UTF-8; 0xFF never occurs in UTF-8, so that no `*` can
confuse host and path: "*.net\\xff/*" is host net or a subdomain of it, with any path from "/" on.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from logweave.llm.common import map_rows

SEP = b"\xff"
#: URLs are moved in groups of about this many state words.
GROUP = 1 << 16


@dataclass(frozen=True)
class Rule:
    """A glob over canonical URLs: `*` any run, `?` any byte. name is reported; the longest name wins, then the first."""

    name: str | None
    glob: bytes
    verdict: str


def host_rule(verdict: str, rule: str) -> Rule:
    """`net/` or `example.net/en/`: a host with its subdomains, and a start of the path."""
    host, _, path = rule.partition("/")
    return Rule(rule, b"*." + host.encode() + SEP + b"/" + path.encode() + b"*", verdict)


#: The rules of the production filter.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The method's own globs, which judge a URL that no host rule fits.
GLOBS = ("*spam*" + "\xff*", "*cheap-*" + "\xff*", "*casino*" + "\xff*", "*.adserver.*" + "\xff*", "*\xff*/ads/*")
RULES = tuple(host_rule(v, r) for v, r in HOST_RULES)
DEFAULTS = tuple(Rule(None, g.encode("latin-1"), "block") for g in GLOBS)


class Automaton:
    """Positions of a glob are its characters without stars; a star before position p lets the state at p - 1 stay."""

    def __init__(self, globs: list[bytes]):
        bits, self.stay_at, self.last, self.open_end, starts, loose = [], [], [], [], [], []
        for g in globs:
            parts, star = [], False
            first = len(bits)
            for c in g:
                if c == 0x2A:
                    star = True
                else:
                    parts.append((c, star))
                    star = False
            bits.append((None, False))  # a bit for "nothing read yet"
            bits.extend(parts)
            starts.append(first)
            self.last.append(len(bits) - 1)
            if star:
                loose.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.masks = np.zeros((256, self.words), np.uint64)
        self.stay, self.init = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        one = lambda at: (at >> 6, np.uint64(1 << (at & 63)))
        for at, (c, star) in enumerate(bits):
            w, b = one(at)
            if c is not None:
                if c == 0x3F:
                    self.masks[:, w] |= b
                else:
                    self.masks[c, w] |= b
                if star:
                    pw, pb = one(at - 1)
                    self.stay[pw] |= pb
        for at in starts:
            w, b = one(at)
            self.init[w] |= b
        for at in loose:
            w, b = one(at)
            self.stay[w] |= b

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Boolean (urls, globs). URLs are moved longest first, so that those that end drop out of the group."""
        out = np.zeros((len(urls), len(self.last)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        step = max(1, GROUP // self.words)
        for lo in range(0, len(order), step):
            part = order[lo : lo + step]
            out[part] = self._run([urls[i] for i in part])
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        data = np.frombuffer(b"".join(urls) or b"\0", np.uint8)
        state = np.repeat(self.init[None, :], len(urls), 0)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(lengths[0]) if len(urls) else 0):
            n = int(np.searchsorted(-lengths, -at, "left"))  # URLs longer than `at` come first
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = moved & self.masks[data[starts[:n] + at]] | now & self.stay
        return np.stack([(state[:, e >> 6] >> np.uint64(e & 63)) & one for e in self.last], 1).astype(bool)


def canonical(url: str | None) -> tuple[str, str, bytes]:
    """Host (A-Z lower-cased) and path; both empty for null or no `://`."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", b"." + SEP
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].translate(_LOWER)
    tail = rest[cut:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    path = tail[:cut]
    return host, path, b"." + host.encode("utf-8", "surrogatepass") + SEP + path.encode("utf-8", "surrogatepass")


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, defaults: tuple[Rule, ...] = DEFAULTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row: the longest fitting rule's verdict, else the defaults', else allow.

    Null and malformed URLs have an empty host and path and are allowed; repeated rows are judged each; only the two
    named columns are read, so others may have any name.
    """
    every = [*rules, *defaults]

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        auto = Automaton([r.glob for r in every])
        rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name or ""), i))

        def flush(part):
            parsed = [canonical(u) for _, u in part]
            for (page, _), (host, path, _), hit in zip(part, parsed, auto.matches([c for _, _, c in parsed]).tolist(), strict=True):
                best = next((i for i in rank if hit[i]), None)
                if best is None:
                    best = next((i for i in range(len(rules), len(every)) if hit[i]), None)
                yield page, host, path, every[best].name if best is not None else None, every[best].verdict if best is not None else "allow"

        part, chars = [], 0
        for r in source:
            part.append(r)
            chars += len(r[1] or "")
            if len(part) >= 4096 or chars > 1 << 22:
                yield from flush(part)
                part, chars = [], 0
        yield from flush(part)

    return map_rows(pages.select(id_col, url_col), rows, f"{id_col} bigint, host string, path string, rule string, verdict string")
