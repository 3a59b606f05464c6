"""Plain-Python models the distributed operators are compared with."""


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
        prev = row
    return prev[-1]


def ratio(a, b):
    return 100.0 if a == b else 200.0 * lcs(a, b) / (len(a) + len(b))


def link(rows, guard=True):
    """rows: (seq, id, email, name); returns {seq: (entity_seq, matched_by)}, taking rows one by one."""
    seeds, out = [], {}
    for seq, id_, mail, name in sorted(rows):
        hit = None
        by_id = [s for s in seeds if id_ and s[1] == id_]
        by_mail = [s for s in seeds if mail and s[2] == mail]
        by_name = [s for s in seeds if name and s[3] == name and not (guard and id_ and s[1])]
        for kind, found in (("id", by_id), ("email", by_mail), ("name", by_name)):
            if found:
                hit = (found[0][0], kind)
                break
        if hit is None:
            seeds.append((seq, id_, mail, name))
            hit = (seq, "seed")
        out[seq] = hit
    return out
