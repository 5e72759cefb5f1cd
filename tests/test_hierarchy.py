import random

from weftgraph.operators import hierarchy


def brute(root, changed, children, most):
    """States of pairs below a root, by what each one reaches."""
    level, seen = [root], {root: 0}
    depth = 0
    while level and len(seen) <= most:
        depth += 1
        level = sorted({c for p in level for _, c in children.get(p, []) if c is not None and c not in seen})
        seen |= dict.fromkeys(level, depth)
    inside = set(sorted(seen, key=lambda p: (seen[p], p))[:most])

    def reached(start):
        found, todo = set(), [start]
        while todo:
            p = todo.pop()
            for c in [c for _, c in children.get(p, []) if c is not None] if p in inside else []:
                if c not in found:
                    found.add(c)
                    todo.append(c)
        return found

    def code(p):
        every = {p} | reached(p)
        if any(q in inside and changed.get(q) for q in every):
            return "contains"
        odd = any(q not in inside or changed.get(q) is None or q in reached(q) or (q in inside and any(c is None for _, c in children.get(q, []))) for q in every)
        return "unknown" if odd else "none"

    return {(root, p, i): code(c) if c is not None else "unknown" for p in inside for i, c in children.get(p, [])}, code(root)


def test_states_equal_a_search_from_every_pair(spark):
    r = random.Random(8)
    pairs, children, roots = {}, {}, []
    for case in range(14):
        n = r.randint(1, 9)
        names = [f"{case:02}p{i}" for i in range(n)]
        roots.append((f"root{case}", names[0]))
        for i, p in enumerate(names):
            if r.random() < 0.9:
                pairs[p] = r.choice([False] * 6 + [True, None])
            ahead = names[i + 1 :] if case % 3 else names
            children[p] = [(f"{p}.{k}", r.choice([*ahead, None] if r.random() < 0.15 else ahead)) for k in range(r.randint(0, 3)) if ahead]
    frame = spark.createDataFrame
    kids = [(p, i, c) for p, rows in children.items() for i, c in rows]
    for most in (512, 4):
        instances, tops = hierarchy.change_index(frame(roots, "root string, pair string"), frame(list(pairs.items()), "pair string, changed boolean"), frame(kids, "pair string, instance string, child string"), most)
        want, states = {}, {}
        for root, p in roots:
            found, state = brute(p, pairs, children, most)
            want |= {(root, q, i): s for (_, q, i), s in found.items()}
            states[root] = state
        assert {(x.root, x.pair, x.instance): x.state for x in instances.collect()} == want
        assert {x.root: x.state for x in tops.collect()} == states and set(states.values()) == {"contains", "unknown", "none"}
        assert all(x.complete for x in tops.collect() if x.state == "none")
