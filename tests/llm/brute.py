from collections import Counter
from hashlib import sha256


def removed(texts, span):
    """Per text: (n_bytes, n_removed, n_spans, sha256 of what is left), by counting every string of span bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, sha256(kept).hexdigest()))
    return out
