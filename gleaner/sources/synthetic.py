"""A seeded image set with planted defects, to try the audit on.

Two kinds of 96 x 96 pictures (a bright disc on dark, a dark square on bright), 111 of them labelled, with
near-duplicates, leaks between splits, wrong labels, an odd size, blank images and broken files.
"""

from __future__ import annotations

import csv
import os

import numpy as np

from gleaner.functions.imaging import encode_png

SIDE, ODD_SIDE = 96, 64


def picture(rng: np.random.Generator, kind: int, side: int = SIDE, noise: int = 14) -> np.ndarray:
    """kind 0: a bright disc on a dark ground; 1: a dark square on a bright one.  Place and size vary."""
    ground = rng.integers(20, 40) if kind == 0 else rng.integers(215, 240)
    px = ground + rng.integers(-noise, noise + 1, (side, side))
    y, x = np.mgrid[:side, :side]
    cy, cx = side / 2 + rng.integers(-(side // 6), side // 6 + 1, 2)
    if kind == 0:
        inside = (y - cy) ** 2 + (x - cx) ** 2 <= (side * rng.uniform(0.15, 0.22)) ** 2
        px[inside] = rng.integers(225, 245)
    else:
        half = side * rng.uniform(0.30, 0.38)
        px[(np.abs(y - cy) <= half) & (np.abs(x - cx) <= half)] = rng.integers(8, 30)
    return np.repeat(np.clip(px, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)


def jittered(px: np.ndarray, rng: np.random.Generator, amount: int = 4) -> np.ndarray:
    """A near copy: every sample moves by up to ``amount``."""
    return np.clip(px.astype(int) + rng.integers(-amount, amount + 1, px.shape), 0, 255).astype(np.uint8)


#: The pictures of the set (file name with a place for a number, how many, kind, label, side, grey noise, source of a copy).
PICTURES = (
    ("train/a_clean_{:02d}.png", 64, 0, "class_a", SIDE, 14, None),
    ("test/a_clean_{:02d}.png", 32, 0, "class_a", SIDE, 14, None),
    ("train/a_mis_{}.png", 2, 0, "class_b", SIDE, 4, None),
    ("train/b_mis_{}.png", 2, 1, "class_a", SIDE, 4, None),
    ("test/b_clean_{:02d}.png", 3, 1, "class_b", SIDE, 14, None),
    ("train/dup_base.png", 1, 0, "class_a", SIDE, 14, None),
    ("train/dup_near_{}.png", 3, 0, "class_a", SIDE, 4, "train/dup_base.png"),
    ("train/leak_src.png", 1, 0, "class_a", SIDE, 14, None),
    ("test/leak_near.png", 1, 0, "class_a", SIDE, 4, "train/leak_src.png"),
    ("test/leak_exact.png", 1, 0, "class_a", SIDE, 0, "train/dup_base.png"),
    ("train/odd_size.png", 1, 0, "class_a", ODD_SIDE, 14, None),
)
#: Blank images (file name, grey) and files of 512 random bytes, all without a label.
BLANK = (("train/degen_black.png", 0), ("train/degen_white.png", 255))
BROKEN = ("train/corrupt_0.png", "train/corrupt_1.jpg", "test/corrupt_2.png")


def planned(seed: int) -> dict[str, tuple[bytes, str | None]]:
    """File name -> (bytes, label or None) of the whole set."""
    rng, out, pixels = np.random.default_rng((seed, SIDE)), {}, {}
    for name, n, kind, label, side, noise, source in PICTURES:
        for rel in map(name.format, range(n)):
            pixels[rel] = picture(rng, kind, side, noise) if source is None else jittered(pixels[source], rng, noise)
            out[rel] = encode_png(pixels[rel]), label
    out |= {rel: (encode_png(np.full((SIDE, SIDE, 3), grey, np.uint8)), None) for rel, grey in BLANK}
    return out | {rel: (rng.bytes(512), None) for rel in BROKEN}


def synth_dataset(out_dir: str, seed: int = 7) -> dict:
    """Write the set into ``out_dir`` (new or empty) and return what was planted."""
    if os.path.isdir(out_dir) and os.listdir(out_dir):
        raise FileExistsError(f"the folder is not empty: {out_dir}")
    made = planned(seed)
    for rel, (data, _) in made.items():
        path = os.path.join(out_dir, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    labelled = sorted((rel, label) for rel, (_, label) in made.items() if label is not None)
    with open(os.path.join(out_dir, "labels.csv"), "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([("filepath", "label"), *labelled])
    wrong = [rel for rel, _ in labelled if "_mis_" in rel]
    minor = sum(label == "class_b" for _, label in labelled)
    return {
        "root": os.path.abspath(out_dir), "labels_csv": os.path.abspath(os.path.join(out_dir, "labels.csv")),
        "planted": {
            "corrupt": len(BROKEN), "corrupt_files": list(BROKEN), "near_duplicate_images": 5, "cross_split_leaks": 2, "mislabeled": len(wrong), "mislabeled_files": wrong, "degenerate": len(BLANK),
            "class_a": len(labelled) - minor, "class_b": minor, "minority_ratio": round(minor / len(labelled), 4),
        },
    }
