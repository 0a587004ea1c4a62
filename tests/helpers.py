"""Small alignments with known results, and plain-Python brute force to compare with."""

from __future__ import annotations

import itertools
from pathlib import Path

STATE = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "Y": 10, "R": 5, "W": 9, "S": 6, "K": 12, "M": 3,
         "B": 14, "D": 13, "H": 11, "V": 7, "N": 15, "X": 15, "?": 15, "-": 15}

# Inputs of published scores and numbers of trees.
# name: (PHYLIP text, kept columns, minimum length, best length, distinct best trees)
SMALL = {
    "ambiguous": (" 5 2\nSpecies_1_UM\nSpecies_2_AY\nSpecies_3_T-\nSpecies_4_TV\nSpecies_5_TN\n", 2, 4, 1, 15),
    "uracil": (" 5 4\nSpecies_1_GGAG\nSpecies_2_TAAT\nSpecies_3_GGUG\nSpecies_4_GGUG\nSpecies_5_TAUT\n", 4, 4, 5, 3),
    "gaps": (
        " 6 27\nSpecies_1 ---AAAAAAAAAAAaaaaAAAAAAAAA\nSpecies_2 ---AAAAAAAAAAAaaaaAAAAAAAAG\n"
        "Species_3 AAAAAAAAAAAAAAaaaaAAAAAaATg\nSpecies_4 AAAAAAAAAAAAAAAAAAAAAAnaCTg\n"
        "Species_5 AAAAAAAAAAAAAAAAAAAAAANUCTG\nSpecies_6 AAAAAAAAAAAAAAAAAAAAAAAUCTG\n", 8, 4, 4, 1,
    ),
    "all_equal": (
        " 6 59\n"
        "Species_1 A---------A---------A---------A---------A---------GGGGGGGGG\n"
        "Species_2 -A-------A-A-------A-A-------A-A-------A-A-------AAAAAAAAAA\n"
        "Species_3 --A-----A---A-----A---A-----A---A-----A---A-----A-AAAAAAAAA\n"
        "Species_4 ---A---A-----A---A-----A---A-----A---A-----A---A--AAAAAAAAA\n"
        "Species_5 ----A-A-------A-A-------A-A-------A-A-------A-A---AAAAAAAAA\n"
        "Species_6 -----A---------A---------A---------A---------A----AAAAAAAAA\n", 59, 9, 9, 105,
    ),
}

#: Matrices of our own; what is expected of them comes from ``brute_force`` below.
FIVE = [("Alder", "ACGTTACA"), ("Birch", "ACGTCACC"), ("Cedar", "TCGACGCA"), ("Dogwood", "TGGACGTC"), ("Elm", "TGCACATA")]
SIX = [
    ("Red fox", "ACCTGATTGACARC"), ("Grey wolf", "ACCTGCTTGACAAC"), ("Lynx", "GCATGCTAGA-AAC"),
    ("Brown bear", "GCATTCAAGTCAYC"), ("Otter", "GGATTCAACTCNAC"), ("Badger", "GGACTAATCTCAGC"),
]
LONG = [(f"Moth no. {i}", "".join("ACGTRN-"[(i * j + j // 3 + i) % 7] for j in range(47))) for i in range(5)]


def phylip(rows: list[tuple[str, str]], per_block: int = 0, interleaved: bool = False) -> str:
    """A PHYLIP file: one line a taxon, or lines of ``per_block`` bases in groups of ten."""
    head = f" {len(rows)} {len(rows[0][1])}\n"
    if not per_block:
        return head + "".join(f"{n:<10}{s}\n" for n, s in rows)
    cut = [
        [" ".join(s[i : i + per_block][j : j + 10] for j in range(0, per_block, 10)) for i in range(0, len(s), per_block)]
        for _, s in rows
    ]
    first = [f"{n:<10}{lines[0]}" for (n, _), lines in zip(rows, cut)]
    if interleaved:
        later = ["\n".join(lines[k] for lines in cut) for k in range(1, len(cut[0]))]
        return head + "\n\n".join(["\n".join(first), *later]) + "\n"
    return head + "".join("\n".join([f, *lines[1:]]) + "\n" for f, lines in zip(first, cut))


def nexus(rows: list[tuple[str, str]], n: int, m: int) -> str:
    body = "".join(f"{name} {seq}\n" for name, seq in rows)
    return f"#NEXUS\nbegin data;\n  dimensions ntax={n} nchar={m};\n  format datatype=dna;\n  matrix\n{body}  ;\nend;\n"


def clustal(rows: list[tuple[str, str]], width: int) -> str:
    blocks = [
        "".join(f"{n:<16}{s[i : i + width]}\n" for n, s in rows) + " " * 17 + "*\n" for i in range(0, len(rows[0][1]), width)
    ]
    return "CLUSTAL W alignment\n\n" + "\n".join(blocks)


#: Line ends of both kinds, a blank line, a wrapped and an indented sequence, no end of line at the end.
FASTA = ">Alder\nACGTTACA\n>Birch\r\nACGTCACC\r\n\n>Cedar\nTCGAC\nGCA\n>Dogwood\n  TGGACGTC\n>Elm\nTGCACATA"


def put(folder: Path, name: str, text: str) -> str:
    """Write one alignment below ``folder`` so that its id is ``name``."""
    place = folder / f"alignment_id={name}"
    place.mkdir(parents=True, exist_ok=True)
    (place / "a.txt").write_text(text)
    return str(folder)


def fitch(parent: list[int], columns: list[list[int]]) -> int:
    """Length of one tree, straight from the definition."""
    n = (len(parent) + 3) // 2
    root = parent.index(-1)
    kids: dict[int, list[int]] = {}
    for b, p in enumerate(parent):
        kids.setdefault(p, []).append(b)
    total = 0
    for column in columns:
        def down(b):
            nonlocal total
            if b < n and b != root:
                return column[b]
            x, y = (down(c) for c in kids[b])
            total += not x & y
            return x & y or x | y
        top = down(root)
        total += not top & column[root]
    return total


def splits(parent: list[int]) -> frozenset:
    """Taxa below each inner branch of a tree rooted at taxon 0."""
    n = (len(parent) + 3) // 2
    out = set()
    for u in range(n, len(parent)):
        members = set()
        for leaf in range(n):
            b = leaf
            while b != -1 and b != u:
                b = parent[b]
            if b == u:
                members.add(leaf)
        out.add(frozenset(members if 0 not in members else set(range(n)) - members))
    return frozenset(out)


def is_tree(parent: list[int]) -> bool:
    """One root, which is a taxon; the root and every inner branch have two children; all reach the root."""
    n = (len(parent) + 3) // 2
    roots = [i for i, p in enumerate(parent) if p == -1]
    if len(roots) != 1 or roots[0] >= n:
        return False
    for b in range(len(parent)):
        kids = [i for i, p in enumerate(parent) if p == b]
        if len(kids) != (2 if b >= n or b == roots[0] else 0):
            return False
        seen, x = 0, b
        while parent[x] != -1:
            x = parent[x]
            seen += 1
            if seen > len(parent):
                return False
    return True


def columns_of(seqs: list[str]) -> list[list[int]]:
    return [[STATE[s[i]] for s in seqs] for i in range(len(seqs[0]))]


def double_factorial(k: int) -> int:
    return 1 if k <= 1 else k * double_factorial(k - 2)


pairs = itertools.combinations


def topologies(n: int) -> list[list[int]]:
    """Every tree of n taxa as a parent array, by adding taxa at all places."""
    trees = [[-1, 0, 0] + [-2] * (2 * n - 6)]
    for taxon in range(3, n):
        node, grown = n + taxon - 3, []
        for parent in trees:
            for b in range(1, len(parent)):
                if parent[b] >= 0:
                    new = parent.copy()
                    new[node], new[b], new[taxon] = parent[b], node, node
                    grown.append(new)
            new = [node if p == 0 else p for p in parent]
            new[node], new[taxon] = 0, 0
            grown.append(new)
        trees = grown
    return trees


def brute_force(rows: list[tuple[str, str]]) -> tuple[int, int, int, int]:
    """Kept columns, minimum length, best length and number of best trees, straight from the definitions."""
    raw = list(zip(*[s for _, s in rows]))
    kept = [c for c in raw if len(set(c)) > 1]
    least = sum(len(set(c) - set("-?NX")) - 1 for c in kept)
    lengths = [fitch(p, columns_of([s for _, s in rows])) for p in topologies(len(rows))]
    return len(kept), least, min(lengths), lengths.count(min(lengths))


SMALL["five"] = (phylip(FIVE), *brute_force(FIVE))
SMALL["six"] = (phylip(SIX), *brute_force(SIX))
