"""Plain definitions for small inputs, written apart from the library."""
import re

STOP = set("""the a an and or but of to in on at for is are was were be been being it its this that these those with as by
we our us i you he she they them has have had do does did will now not no yes from into per via so if then""".split())


def toks(s):
    return {w for w in re.split("[^a-z0-9]+", (s or "").lower()) if len(w) > 1 and w not in STOP}


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def leaders(rows, threshold):
    """rows: [(id, scope, text)] in order -> {id: leader id}"""
    heads, out = {}, {}
    for i, scope, text in rows:
        t = toks(text)
        for j, u in heads.setdefault(scope, []):
            if jac(t, u) >= threshold:
                out[i] = j
                break
        else:
            heads[scope].append((i, t))
            out[i] = i
    return out
