"""Options of the three workflows: a default, over it the command line, over that a YAML file."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass
from types import SimpleNamespace

from kindred.operators.representatives import POLICIES


class OptionError(ValueError):
    """An option that is unknown, of the wrong kind, or out of range."""


@dataclass(frozen=True)
class Option:
    default: object = None
    kind: type = str
    choices: tuple[str, ...] = ()
    many: bool = False


# Names and defaults of the options.
_MATCH = {
    "cosine_auto": Option(0.97, float), "cosine_verify": Option(0.90, float), "cosine_review": Option(0.85, float), "phash_auto_distance": Option(4, int), "phash_verify_distance": Option(8, int),
    "model": Option("text-stand-in"), "batch_size": Option(128, int), "metadata_workers": Option(4, int), "loader_workers": Option(0, int), "gpus": Option(None, int), "gpu_memory_fraction": Option(0.9, float),
}
_GROUP = {"k": Option(50, int), "grouping": Option("connected", str, ("connected", "agglomerative")), "agglomerative_linkage": Option("complete", str, ("complete", "average")), "agglomerative_cosine_threshold": Option(None, float)}
_ACT = {"inplace": Option(False, bool), "hard_delete": Option(False, bool), "yes": Option(False, bool), "report": Option(), "no_report": Option(False, bool)}
OPTIONS = {
    "dedup": {"folders": Option(many=True), **_MATCH, **_GROUP, "save_faiss_index": Option(False, bool), "keep_policy": Option("highest-resolution", str, POLICIES), "cross_folder_only": Option(False, bool), **_ACT},
    "remove-like": {"folder": Option(), "image": Option(), **_MATCH, **_ACT},
    "select": {
        "folder": Option(), "output": Option(), "num": Option(None, int), "selection_method": Option("hybrid", str, ("hybrid", "kmeans", "farthest")), "copy_mode": Option("copy", str, ("copy", "hardlink", "symlink")),
        "force": Option(False, bool), "seed": Option(42, int), "make_preview": Option(False, bool), "preview_columns": Option(8, int), "preview_size": Option(192, int), "reject_low_quality": Option(False, bool),
        "min_width": Option(224, int), "min_height": Option(224, int), "min_blur_score": Option(20.0, float), "min_brightness": Option(15.0, float), "max_brightness": Option(240.0, float),
        "keep_policy": Option("best-quality", str, POLICIES), **_MATCH, **_GROUP,
    },
}
POSITIONAL = ("folders", "folder", "image")


def _value(name: str, o: Option, text: str):
    try:
        value = o.kind(text)
    except ValueError:
        raise OptionError(f"{name}: {text!r} is no {o.kind.__name__}") from None
    if o.choices and value not in o.choices:
        raise OptionError(f"{name}: {text!r} is none of {', '.join(o.choices)}")
    return value


def read_yaml(path: str) -> dict:
    """Option name -> node of a YAML file. Nodes keep what was quoted, and leave `yes`, `no`, `on` and `off` text as in YAML 1.2."""
    try:
        import yaml
    except ImportError:
        raise OptionError("reading a config file needs PyYAML") from None
    try:
        with open(path, encoding="utf-8") as f:
            root = yaml.compose(f, Loader=yaml.SafeLoader)
    except (OSError, yaml.YAMLError) as e:
        raise OptionError(f"can't read {path}: {e}") from None
    if root is None:
        return {}
    if not isinstance(root, yaml.MappingNode) or not all(isinstance(k, yaml.ScalarNode) for k, _ in root.value):
        raise OptionError(f"{path} must hold a mapping of option names")
    return {k.value: v for k, v in root.value}


def _plain(node) -> str | None:
    """The text of an unquoted scalar in lower case, else None."""
    return node.value.lower() if node.id == "scalar" and node.style is None else None


def _from_node(name: str, o: Option, node):
    if _plain(node) in ("", "~", "null"):
        if o.default is not None:
            raise OptionError(f"{name} can't be null")
        return None
    if o.kind is bool:
        if _plain(node) not in ("true", "false"):
            raise OptionError(f"{name} must be true or false")
        return _plain(node) == "true"
    items = node.value if node.id == "sequence" else [node]
    if (node.id == "sequence") != o.many or any(n.id != "scalar" for n in items):
        raise OptionError(f"{name} must be {'a list' if o.many else 'one value'}")
    values = [_value(name, o, n.value) for n in items]
    return values if o.many else values[0]


def _from_line(command: str, argv: list[str]) -> dict:
    parser = argparse.ArgumentParser(prog=f"kindred {command}", argument_default=argparse.SUPPRESS)
    parser.add_argument("--config")
    for name, o in OPTIONS[command].items():
        if name in POSITIONAL:
            parser.add_argument(name, nargs="*" if o.many else "?")
        elif o.kind is bool:
            parser.add_argument(f"--{name.replace('_', '-')}", action="store_true")
        else:
            parser.add_argument(f"--{name.replace('_', '-')}", type=o.kind, choices=o.choices or None)
    given = vars(parser.parse_args(argv))
    return {k: v for k, v in given.items() if k != "config" and v not in (None, [])}


def options(argv: list[str]) -> SimpleNamespace:
    """The command and its options. The first word may name the command, else the file's `command`, else it is dedup."""
    argv = list(argv)
    named = argv.pop(0) if argv and argv[0] in OPTIONS else None
    first = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    first.add_argument("--config")
    config = first.parse_known_args(argv)[0].config
    nodes = read_yaml(config) if config else {}
    wanted = nodes.pop("command").value if "command" in nodes else (named or "dedup" if not nodes else "dedup")
    if wanted not in OPTIONS:
        raise OptionError(f"command: {wanted!r} is none of {', '.join(OPTIONS)}")
    if named and named != wanted:
        raise OptionError(f"the file is for {wanted}, the command line for {named}")
    known = OPTIONS[wanted]
    if strange := sorted(set(nodes) - set(known)):
        raise OptionError(f"unknown options for {wanted}: {', '.join(strange)}")
    merged = {k: o.default for k, o in known.items()} | _from_line(wanted, argv) | {k: _from_node(k, known[k], v) for k, v in nodes.items()}
    return check(SimpleNamespace(command=wanted, **merged))


def check(o: SimpleNamespace) -> SimpleNamespace:
    """Ranges and combinations; sets `folders` and the default report path."""
    rules: list[tuple[bool, str]] = []
    if o.command != "dedup":
        o.folders = [o.folder] if o.folder else []
    rules.append((bool(o.folders), "a folder is required"))
    rules += [(os.path.isdir(f), f"{f} is no folder") for f in o.folders or []]
    if o.command == "remove-like":
        rules.append((bool(o.image) and os.path.isfile(o.image), "remove-like needs an image file"))
    if o.command == "select":
        rules += [
            (bool(o.output) and o.num is not None, "select needs output and num"), (o.num is None or o.num >= 1, "num must be at least 1"), (min(o.min_width, o.min_height) >= 1, "min_width and min_height must be at least 1"),
            (0 <= o.min_brightness <= o.max_brightness <= 255, "0 <= min_brightness <= max_brightness <= 255 must hold"), (o.preview_columns >= 1 and o.preview_size >= 32, "preview_columns must be at least 1, preview_size at least 32"),
        ]
    rules += [
        (0.1 <= o.gpu_memory_fraction <= 1, "gpu_memory_fraction must be between 0.1 and 1"), (o.cosine_review <= o.cosine_verify <= o.cosine_auto, "cosine_review <= cosine_verify <= cosine_auto must hold"),
        (o.metadata_workers >= 1, "metadata_workers must be at least 1"), (o.loader_workers >= 0, "loader_workers must be at least 0"),
    ]
    if o.command != "select":
        rules += [(o.yes or not o.hard_delete, "hard_delete needs yes"), (not (o.no_report and o.report), "report and no_report exclude each other")]
    threshold = getattr(o, "agglomerative_cosine_threshold", None)
    rules.append((threshold is None or -1 <= threshold <= 1, "agglomerative_cosine_threshold must be between -1 and 1"))
    for holds, message in rules:
        if not holds:
            raise OptionError(message)
    o.root = o.folders[0] if len(o.folders) == 1 else os.getcwd()
    if o.command != "select" and not o.no_report and o.report is None:
        o.report = os.path.join(o.root, "remove_like_report.json" if o.command == "remove-like" else "dedup_report.json")
    return o
