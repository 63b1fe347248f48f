"""Small inputs and sequential reference algorithms for the tests."""

import random

# Weighted sequences, one character per item.
WEIGHTED = [
    ("acdeh", 455), ("abdeg", 191), ("adceh", 177), ("abdeh", 144), ("acdeg", 111), ("adceg", 82), ("adbeh", 56),
    ("acdefdbeh", 47), ("adbeg", 38), ("acdefbdeh", 33), ("acdefbdeg", 14), ("acdefdbeg", 11), ("adcefcdeh", 9),
    ("adcefdbeh", 8), ("adcefbdeg", 5), ("acdefbdefdbeg", 3), ("adcefbeg", 2), ("adcefbdefbdeg", 2),
    ("adcefdbefbdeh", 1), ("adbefbdefdbeg", 1), ("adcefdbefcdefdbeg", 1),
]

# The state network of 50 category sequences.
CATEGORIES = [
    ("Tecnologia", "Mercearia", 75), ("Mercearia", "Tecnologia", 74), ("Limpeza", "Mercearia", 29), ("Tecnologia", "Higiene", 26),
    ("Higiene", "Tecnologia", 24), ("Higiene", "Mercearia", 23), ("Limpeza", "Tecnologia", 23), ("Mercearia", "Higiene", 23),
    ("Tecnologia", "Limpeza", 22), ("Mercearia", "Limpeza", 18), ("Higiene", "Limpeza", 11), ("Limpeza", "Higiene", 4),
    ("Mercearia", "SINK", 25), ("Tecnologia", "SINK", 15), ("Higiene", "SINK", 5), ("Limpeza", "SINK", 5),
    ("SOURCE", "Tecnologia", 17), ("SOURCE", "Mercearia", 13), ("SOURCE", "Higiene", 10), ("SOURCE", "Limpeza", 10),
]


def weighted_sequences(spark):
    rows = [("w", i, list(s), n) for i, (s, n) in enumerate(WEIGHTED)]
    return spark.createDataFrame(rows, "graph_id string, seq_id long, items array<string>, weight long")


def edges(spark, rows):
    """``rows`` are (graph, src, dst, weight)."""
    return spark.createDataFrame([(g, a, b, float(w)) for g, a, b, w in rows], "graph_id string, src string, dst string, weight double")


def random_networks(count, seed, most=8, heaviest=6, loops=False):
    """Small random networks with many equal weights."""
    rng = random.Random(seed)
    out = {}
    for k in range(count):
        names = [f"n{i}" for i in range(rng.randint(2, most))]
        density = rng.choice([0.3, 0.6, 1.0])
        net = {(a, b): float(rng.randint(1, heaviest)) for a in names for b in names if (loops or a != b) and rng.random() < density}
        if not net:
            net[(names[0], names[1])] = 1.0
        out[f"g{k:03d}"] = net
    return out


def as_rows(networks):
    return [(g, a, b, w) for g, net in networks.items() for (a, b), w in net.items()]


def order(item):
    (a, b), w = item
    return (-w, a, b)


def sequential_forward(net, root):
    seen, tree = {root}, []
    while True:
        open_edges = [e for e in net.items() if e[0][0] in seen and e[0][1] not in seen]
        if not open_edges:
            return tree
        best = min(open_edges, key=order)
        tree.append((*best[0], best[1]))
        seen.add(best[0][1])


def sequential_polytree(net, start=None, start_node=None, max_depth=None, max_edges=None):
    if start_node is None:
        start = start or min(net.items(), key=order)[0]
        at, tree = {start[0]: 0, start[1]: 1}, [(*start, net[start], 0, "INITIAL")]
    else:
        at, tree = {start_node: 0}, []
    while max_edges is None or len(tree) < max_edges:
        choices = []
        for (a, b), w in net.items():
            if (a in at) == (b in at):
                continue
            old, new, way = (a, b, "FORWARD") if a in at else (b, a, "BACKWARD")
            if max_depth is None or at[old] < max_depth:
                choices.append((-w, a, b, new, at[old] + 1, way))
        if not choices:
            return tree
        w, a, b, new, level, way = min(choices)
        at[new] = level
        tree.append((a, b, -w, level, way))
    return tree


def sequential_queue(net, root, top_k, max_depth):
    seen, queue, out = {root}, [(root, 0)], []
    while queue:
        node, level = queue.pop(0)
        if level >= max_depth:
            continue
        options = sorted(((a, b), w) for (a, b), w in net.items() if a == node and b not in seen)
        for (a, b), w in sorted(options, key=lambda e: (-e[1], e[0][1]))[:top_k]:
            out.append((a, b, w, level + 1))
            seen.add(b)
            queue.append((b, level + 1))
    return out


def sequential_simplified(net):
    total = {}
    for (a, _), w in net.items():
        total[a] = total.get(a, 0) + w
    target = {}
    for (a, b), w in sorted(net.items(), key=lambda e: (-(e[1] / total[e[0][0]] * 100), -e[1], e[0])):
        if a in target:
            continue
        step, free = b, True
        while step is not None:
            if step == a:
                free = False
                break
            step = target.get(step)
        if free:
            target[a] = b
    return {(a, b) for a, b in target.items()}


def reachable(net, root):
    seen, stack = {root}, [root]
    while stack:
        node = stack.pop()
        for a, b in net:
            if a == node and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def best_branching_weight(net, root):
    """Largest weight over all choices of one in-edge per reachable node that form a tree."""
    nodes = sorted(reachable(net, root) - {root})
    options = [[(a, w) for (a, b), w in net.items() if b == n and a != n and (a == root or a in nodes)] for n in nodes]
    best = None

    def climb(parent):
        for n in nodes:
            step, hops = n, 0
            while step != root:
                step, hops = parent[step], hops + 1
                if hops > len(nodes):
                    return False
        return True

    def search(i, parent, weight):
        nonlocal best
        if i == len(nodes):
            if (best is None or weight > best) and climb(parent):
                best = weight
            return
        for a, w in options[i]:
            search(i + 1, {**parent, nodes[i]: a}, weight + w)

    search(0, {}, 0.0)
    return best


def sequential_multiobjective(net, root, central, max_depth=5, branching=3, target=0.7):
    """Level-by-level scoring with the default weights."""
    total, top = sum(net.values()), max(net.values())
    out = {}
    for (a, _), w in net.items():
        out[a] = out.get(a, 0) + w
    front, chosen, seen, kept, repeats, used = [(root, [root])], [], set(), 0.0, {}, {}
    for level in range(1, max_depth + 1):
        if not front or kept / total >= target:
            break
        found = []
        for node, path in front:
            for (a, b), w in net.items():
                if a != node or b in path or used.get(a, 0) >= branching:
                    continue
                covered = 0.0 if (a, b) in seen else w / total
                crowd = repeats.get(b, 0) / max(1, len(chosen))
                cost = min(1.0, level / max_depth + used.get(a, 0) / branching)
                score = 0.35 * w / top + 0.25 * w / out[a] + 0.15 * covered + 0.15 * central[b] - 0.05 * crowd - 0.05 * cost
                if score >= 0:
                    found.append((-score, -w, b, a, path))
        front, taken = [], 0
        for score, w, b, a, path in sorted(found):
            if taken >= branching:
                break
            if used.get(a, 0) >= branching:
                continue
            chosen.append((a, b, -w, level, " -> ".join(path)))
            taken += 1
            used[a] = used.get(a, 0) + 1
            if (a, b) not in seen:
                seen.add((a, b))
                kept += -w
            repeats[b] = repeats.get(b, 0) + 1
            front.append((b, [*path, b]))
            if kept / total >= target:
                break
    return chosen
