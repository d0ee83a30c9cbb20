"""Project settings: read, checked and resolved on the driver."""

from __future__ import annotations

import os

from sieveline.sources.tables import read_json


def problems(c: dict, images: int | None = 260) -> list[str]:
    """What is wrong with a project's settings, in a fixed order. ``images``: how many the benchmark must have, None for any."""
    bench, train, score, out = c["benchmark"], c["training"], c["evaluation"], []
    say = lambda bad, text: out.append(text) if bad else None
    classes, each, grid, parts = bench["expected_classes"], bench["samples_per_class"], train["global_threshold_grid"], train["recipe_split_fractions"]
    splits = ("train", "validation", "test")
    say(sum(bench[f"{s}_per_class"] for s in splits) != each, "splits of a class don't add up to samples_per_class")
    say(len(set(classes)) < len(classes), "expected_classes repeat")
    say(images is not None and each * len(classes) != images, f"the benchmark needs {images} images")
    say(bench["required_annotators"] != 2, "two annotators are needed")
    say(sorted(bench["secondary_annotation_splits"]) != ["test", "validation"], "the second annotator labels validation and test")
    say(bench["quality_candidates_per_class"] < each, "fewer quality candidates than samples")
    say(not str(bench["quality_screen_version"]).strip(), "quality_screen_version is blank")
    say(not grid or any(a >= b for a, b in zip(grid, grid[1:])), "global_threshold_grid must rise")
    say(not all(0 < t < 1 for t in grid), "global_threshold_grid must lie within (0, 1)")
    say(set(parts) != set(splits), "recipe_split_fractions must name the three splits")
    say(abs(sum(parts.values()) - 1) > 1e-9, "recipe_split_fractions must add up to 1")
    for name in ("pretraining_epochs", "finetuning_epochs", "batch_size", "image_size"):
        say(int(train[name]) < 1, f"{name} must be positive")
    say(train["learning_rate"] <= 0 or train["weight_decay"] < 0, "learning_rate must be positive and weight_decay not negative")
    for name in ("model_id", "revision", "prompt_version"):
        say(not str(c["vlm"][name]).strip(), f"{name} is blank")
    say(not 0 < score["confidence_level"] < 1, "confidence_level must lie within (0, 1)")
    say(min(score["bootstrap_iterations"], score["permutation_iterations"], score["precision_at_k"]) < 1, "iterations and precision_at_k must be positive")
    return out


def load(path: str) -> dict:
    c = read_json(path)
    if found := problems(c):
        raise ValueError("; ".join(found))
    return c


def folder(variable: str, default: str) -> str:
    """A folder from the environment, else a default, made absolute."""
    return os.path.abspath(os.environ.get(variable) or default)
