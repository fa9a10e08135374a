"""The lexicon as tasks hold it: a prefix map over row numbers, and searches along a text."""

from __future__ import annotations

from array import array
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.operators.lexicon import NO_CONNECTION, UNKNOWN_COST, Categories, Lexicon

MOST_ENTRIES = 2_000_000
MOST_BYTES = 256 << 20  # of surfaces and features that every task holds
MOST_CELLS = 64 << 20  # of the connection matrix, 4 bytes each


def fits(entries: DataFrame, most_entries: int = MOST_ENTRIES) -> bool:
    """Whether the entries of a lexicon are few enough to be held by every task."""
    text = F.coalesce(F.octet_length("surface"), F.lit(0)) + F.coalesce(F.octet_length("feature"), F.lit(0))
    size = entries.agg(F.count(F.lit(1)), F.sum(text)).first()
    return size[0] <= most_entries and (size[1] or 0) <= MOST_BYTES


class Matrix:
    """Connection costs as rows by right id of columns by left id, over the ids that occur; the
    last row and column stand for all other ids."""

    def __init__(self, right: np.ndarray, left: np.ndarray, cost: np.ndarray):
        rights, lefts = np.unique(right), np.unique(left)
        self.costs = np.full((len(rights) + 1, len(lefts) + 1), NO_CONNECTION, np.int32)
        self.costs[np.searchsorted(rights, right), np.searchsorted(lefts, left)] = cost
        self.rights, self.lefts = ({int(x): i for i, x in enumerate(ids)} for ids in (rights, lefts))

    @classmethod
    def of(cls, connections: DataFrame) -> Matrix:
        """Of several costs of one pair of ids the greatest counts; cells are counted before they are gathered."""
        cells = connections.where("right_id is not null and left_id is not null").groupBy("right_id", "left_id").agg(F.max("cost").alias("cost"))
        if connections.count() > MOST_CELLS and cells.count() > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} connection costs")
        right, left, cost = (c.to_numpy() for c in cells.toArrow().columns)
        sizes = len(np.unique(right)) + 1, len(np.unique(left)) + 1
        if sizes[0] * sizes[1] > MOST_CELLS:
            raise ValueError(f"a connection matrix of {sizes[0]} x {sizes[1]} ids exceeds {MOST_CELLS} cells")
        return cls(right, left, cost)

    def right(self, i: int) -> int:
        return self.rights.get(i, len(self.rights))

    def left(self, i: int) -> int:
        return self.lefts.get(i, len(self.lefts))

    def rows(self) -> list[array]:
        return [array("i", row.tobytes()) for row in self.costs]

    def cost(self, right_id: int, left_id: int) -> int:
        return int(self.costs[self.right(right_id), self.left(left_id)])


@dataclass
class Words:
    """Entries, then unknown-word templates, as one Arrow table, in the order that decides ties; a
    node of the solvers is a row number. What the solvers look up is built once per process."""

    table: pa.Table
    known: int
    matrix: Matrix
    categories: Categories
    ready: bool = False

    @classmethod
    def fitting(cls, lexicon: Lexicon, most_entries: int = MOST_ENTRIES) -> Words | None:
        """The lexicon if every task can hold it; its entries are computed once for that."""
        entries = lexicon.entries.persist()
        try:
            return cls.of(replace(lexicon, entries=entries)) if fits(entries, most_entries) else None
        finally:
            entries.unpersist()

    @classmethod
    def of(cls, lexicon: Lexicon) -> Words:
        columns = ["surface", "layer", "word_id", "left_id", "right_id", "pos_id", "wcost", "feature"]
        entries = lexicon.entries.where("surface is not null and surface <> ''").select(*columns, F.coalesce("word_id", F.lit(-1)).alias("_word")).toArrow()
        entries = entries.sort_by([(c, "ascending") for c in ("surface", "layer", "_word", "wcost", "left_id", "feature")]).select(columns)
        templates = lexicon.unknown.select(F.col("category").alias("surface"), "entry_ix", F.lit(1).alias("layer"), F.lit(None).cast("long").alias("word_id"), *columns[3:]).toArrow()
        templates = templates.sort_by([("surface", "ascending"), ("entry_ix", "ascending")]).drop_columns("entry_ix")
        return cls(pa.concat_tables([entries, templates.cast(entries.schema)]), len(entries), Matrix.of(lexicon.connections), lexicon.categories())

    def __getstate__(self) -> dict:
        return {"table": self.table, "known": self.known, "matrix": self.matrix, "categories": self.categories, "ready": False}

    def prepare(self) -> Words:
        if self.ready:
            return self
        names = self.table.column("surface").to_pylist()
        self.words: dict[str, list[int]] = {}
        self.unknown: dict[str, list[int]] = {}
        lengths: dict[str, set[int]] = {}
        for i in range(self.known):
            self.words.setdefault(names[i], []).append(i)
        for surface in self.words:
            lengths.setdefault(surface[0], set()).add(len(surface))
        self.lengths = {c: sorted(found) for c, found in lengths.items()}
        for i in range(self.known, len(names)):
            self.unknown.setdefault(names[i], []).append(i)
        # A category without a template has one of its own, made when it is met.
        self.lefts = [self.matrix.left(x) for x in self.table.column("left_id").to_pylist()]
        self.rights = [self.matrix.right(x) for x in self.table.column("right_id").to_pylist()]
        self.costs = self.table.column("wcost").to_pylist()
        self.made: list[str] = []
        self.rows = self.matrix.rows()
        self.border = (self.matrix.left(0), self.matrix.right(0))
        self.ready = True
        return self

    def templates(self, kind: str) -> list[int]:
        found = self.unknown.get(kind)
        if found is None:
            found = self.unknown[kind] = [len(self.costs)]
            self.made.append(kind)
            self.lefts.append(self.border[0])
            self.rights.append(self.border[1])
            self.costs.append(UNKNOWN_COST)
        return found

    def members(self) -> pa.Table:
        """The table with the templates that were made."""
        n = len(self.made)
        zeros, columns = pa.array([0] * n, pa.int32()), self.table.schema
        made = [self.made, [1] * n, [None] * n, zeros, zeros, zeros, [UNKNOWN_COST] * n, [f"未知語,{kind}" for kind in self.made]]
        return pa.concat_tables([self.table, pa.table([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(made, columns)], schema=columns)])

    def nodes(self, text: str) -> list[list[tuple[int, int]]]:
        """(start, row) of all nodes by end position, in the order that decides ties."""
        n = len(text)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        kinds: list[str] = []
        for i in range(n):
            found = False
            for length in self.lengths.get(text[i], ()):
                entries = self.words.get(text[i : i + length])
                if entries is not None and i + length <= n:
                    found = True
                    ending[i + length] += [(i, e) for e in entries]
            if found:
                continue
            kinds = kinds or [*map(self.categories, text), ""]
            templates = self.templates(kinds[i])
            ending[i + 1] += [(i, e) for e in templates]
            end = i + 1
            while kinds[i] in self.categories.grouping and kinds[end] == kinds[i]:
                end += 1
                ending[end].append((i, templates[0]))
        return ending

    def entries(self, text: str) -> list[tuple[int, int, int, int, int, int, int, bool]]:
        """(end, place, node, cumulative cost, connection cost, end and place of the predecessor, on the best path) of all
        nodes by end position; the begin is place -1 at 0, nodes that no path reaches are left out."""
        ending = self.nodes(text)
        n = len(text)
        costs: list[list[tuple]] = [[(0, -1, self.border[1])]] + [[] for _ in range(n)]
        rows: dict[tuple[int, int], tuple] = {}
        for end in range(1, n + 1):
            for place, (start, node) in enumerate(ending[end]):
                if costs[start]:
                    ways = [(cost + self.rows[right][self.lefts[node]], at, self.rows[right][self.lefts[node]]) for cost, at, right in costs[start]]
                    cost, at, c = min(ways, key=_cost)
                    rows[end, place] = (node, cost + self.costs[node], c, start, at)
                    costs[end].append((cost + self.costs[node], place, self.rights[node]))
        best = set()
        at = min(((cost + self.rows[right][self.border[0]], place) for cost, place, right in costs[n]), key=_cost, default=(0, -1))[1]
        end = n
        while at >= 0:
            best.add((end, at))
            end, at = rows[end, at][3], rows[end, at][4]
        return [(e, p, *row, (e, p) in best) for (e, p), row in rows.items()]

    def edges(self, text: str) -> list[tuple[int, int, int, int, int, int, bool]]:
        """(end and place of the node before, end and place of the node after, connection cost, word cost, on the best path) of
        all edges; the begin is place -1 at 0, the end place -1 behind the text."""
        ending = self.nodes(text)
        n = len(text)
        best, last = set(), (0, -1)
        for start, end, node, _ in self.best(text)[1]:
            at = (end, ending[end].index((start, node)))
            best.add((last, at))
            last = at
        best.add((last, (n + 1, -1)))
        before = [[(place, self.rights[node]) for place, (_, node) in enumerate(found)] for found in ending]
        before[0] = [(-1, self.border[1])]
        out = []
        for end, found in enumerate(ending):
            for place, (start, node) in enumerate(found):
                for at, right in before[start]:
                    out.append((start, at, end, place, self.rows[right][self.lefts[node]], self.costs[node], ((start, at), (end, place)) in best))
        for at, right in before[n]:
            out.append((n, at, n + 1, -1, self.rows[right][self.border[0]], 0, ((n, at), (n + 1, -1)) in best))
        return out

    # A state: (cost, start of its node, node, state before, connection cost to it, right id)

    def best(self, text: str, compat_eos: bool = False) -> tuple[int, list[tuple[int, int, int, int]]]:
        """Cost and (start, end, node, connection cost) of the cheapest path."""
        n = len(text)
        lengths, words, lefts, rights, costs, rows = self.lengths, self.words, self.lefts, self.rights, self.costs, self.rows
        kept: list[dict[int, tuple]] = [{} for _ in range(n + 1)]
        kept[0][self.border[1]] = (0, -1, -1, None, 0, self.border[1])
        run, run_kind = None, ""
        kind_of, grouping = self.categories, self.categories.grouping
        for i in range(n):
            here = kept[i]
            states = list(here.values())
            if len(states) > 1:
                states.sort(key=_start)
            before: dict[int, tuple] = {}
            found = False
            c = text[i]
            for length in lengths.get(c, ()):
                entries = words.get(text[i : i + length])
                if entries is None or i + length > n:
                    continue
                found = True
                if not states:
                    break
                target = kept[i + length]
                for e in entries:
                    left = lefts[e]
                    p = before.get(left)
                    if p is None:
                        p = before[left] = _cheapest(states, rows, left)
                    cost, right = p[0] + costs[e], rights[e]
                    old = target.get(right)
                    if old is None:
                        target[right] = (cost, i, e, p[1], p[2], right)
                    elif cost < old[0]:
                        del target[right]
                        target[right] = (cost, i, e, p[1], p[2], right)
            kind = ""
            if run is not None:
                kind = kind_of(c)
                if kind != run_kind:
                    run = None
            if not found and states:
                kind = kind or kind_of(c)
                templates = self.templates(kind)
                target = kept[i + 1]
                for e in templates:
                    left = lefts[e]
                    p = before.get(left)
                    if p is None:
                        p = before[left] = _cheapest(states, rows, left)
                    cost, right = p[0] + costs[e], rights[e]
                    old = target.get(right)
                    if old is None or cost < old[0]:
                        if old is not None:
                            del target[right]
                        target[right] = (cost, i, e, p[1], p[2], right)
                if kind in grouping:
                    e = templates[0]
                    p = before[lefts[e]]
                    if run is None or p[0] + costs[e] < run[0]:
                        run, run_kind = (p[0] + costs[e], i, e, p[1], p[2], rights[e]), kind
            if run is not None and run[1] < i:
                target = kept[i + 1]
                old = target.get(run[5])
                if old is None or run[0] < old[0] or (run[0] == old[0] and run[1] < old[1]):
                    target[run[5]] = run
        states = sorted(kept[n].values(), key=_start)
        cost, last, c = _cheapest(states, rows, self.border[0])
        if compat_eos and n:
            word = min(states, key=lambda s: s[0])
            if word[0] <= cost:
                return word[0], _path(word[3], word[1])
        return cost, _path(last, n)

    def k_best(self, text: str, k: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
        """The k cheapest paths, as ``best`` gives one."""
        n = len(text)
        lefts, rights, costs, rows = self.lefts, self.rights, self.costs, self.rows
        kept: list[dict[int, list[tuple]]] = [{} for _ in range(n + 1)]
        kept[0][self.border[1]] = [(0, -1, -1, None, 0, self.border[1])]
        run: list[tuple] = []
        run_kind = ""
        grouping = self.categories.grouping

        def options(states: list[tuple], left: int) -> list[tuple]:
            ways = [(s[0] + rows[s[5]][left], s, rows[s[5]][left]) for s in states]
            ways.sort(key=_cost)
            return ways[:k]

        for i in range(n + 1):
            states: list[tuple] = []
            for same in kept[i].values():
                same.sort(key=_cost_start)
                del same[k:]
                states += same
            states.sort(key=_start)
            if i == n:
                return [(cost, _path(s, n)) for cost, s, _ in options(states, self.border[0])]
            before: dict[int, list[tuple]] = {}

            def push(e: int, end: int) -> list[tuple]:
                left = lefts[e]
                if left not in before:
                    before[left] = options(states, left)
                new = [(cost + costs[e], i, e, s, c, rights[e]) for cost, s, c in before[left]]
                kept[end].setdefault(rights[e], []).extend(new)
                return new

            found = False
            for length in self.lengths.get(text[i], ()):
                entries = self.words.get(text[i : i + length])
                if entries is not None and i + length <= n:
                    found = True
                    for e in entries if states else ():
                        push(e, i + length)
            kind = self.categories(text[i]) if run or not found else ""
            if kind != run_kind:
                run = []
            if not found and states:
                templates = self.templates(kind)
                new = [push(e, i + 1) for e in templates]
                if kind in grouping:
                    run = sorted(run + new[0], key=_cost)[:k]
                    run_kind = kind
            group = [s for s in run if s[1] < i]
            if group:
                kept[i + 1].setdefault(group[0][5], []).extend(group)
        return []


def _start(state: tuple) -> int:
    return state[1]


def _cost(state: tuple) -> int:
    return state[0]


def _cost_start(state: tuple) -> tuple[int, int]:
    return state[0], state[1]


def _cheapest(states: list[tuple], rows: list[array], left: int) -> tuple:
    """Cost, state and connection cost of the first of the cheapest ways to a left id."""
    first = states[0]
    c = rows[first[5]][left]
    best = (first[0] + c, first, c)
    for s in states[1:]:
        c = rows[s[5]][left]
        if s[0] + c < best[0]:
            best = (s[0] + c, s, c)
    return best


def _path(state: tuple | None, end: int) -> list[tuple[int, int, int, int]]:
    path = []
    while state is not None and state[2] >= 0:
        path.append((state[1], end, state[2], state[4]))
        end, state = state[1], state[3]
    return path[::-1]
