from collections import defaultdict

import numpy as np


def strip(docs, span=200):
    """Brute-force removal of repeated strings: id to text."""
    seen = defaultdict(list)
    texts = [(i, (t or "").encode()) for i, t in docs]
    for n, (_, b) in enumerate(texts):
        for k in range(len(b) - span + 1):
            seen[b[k : k + span]].append((n, k))
    gone = [np.zeros(len(b), bool) for _, b in texts]
    for places in seen.values():
        if len(places) > 1:
            for n, k in places:
                gone[n][k : k + span] = True
    return {i: bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore") for (i, b), g in zip(texts, gone)}
