"""Where a data set's files are: folder layouts, catalogues of names, calibrations."""

from __future__ import annotations

import re

from . import files

#: Names of the event-camera data set's recordings.
ECD_REAL = (
    "shapes_rotation", "shapes_translation", "shapes_6dof", "poster_rotation", "poster_translation", "poster_6dof", "boxes_rotation", "boxes_translation", "boxes_6dof", "hdr_poster", "hdr_boxes",
    "outdoors_walking", "outdoors_running", "dynamic_rotation", "dynamic_translation", "dynamic_6dof", "calibration", "office_zigzag", "office_spiral", "urban", "slider_close", "slider_far", "slider_hdr_close",
    "slider_hdr_far", "slider_depth",
)
ECD_SYNTHETIC = ("simulation_3planes", "simulation_3walls")


def davis_recording(root: str, name: str | None = None) -> str:
    """The folder with events.txt: the named one, root itself, or the only child that has it."""
    if name is not None:
        if not files.exists(f"{root}/{name}/events.txt"):
            raise FileNotFoundError(f"{root}/{name}/events.txt")
        return f"{root}/{name}"
    if files.exists(f"{root}/events.txt"):
        return root
    found = [c for c in children(root) if files.exists(f"{c}/events.txt")]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} recordings below {root}")
    return found[0]


def children(root: str) -> list[str]:
    from pyarrow import fs

    system, at = files.opened(root)
    return sorted(i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory)


def available(root: str, catalogue: tuple[str, ...] = ECD_REAL + ECD_SYNTHETIC) -> list[str]:
    """Names of the catalogue that are below root."""
    there = {c.rsplit("/", 1)[-1] for c in children(root)}
    return [n for n in catalogue if n in there]


def validated(name: str, catalogue: tuple[str, ...] = ECD_REAL + ECD_SYNTHETIC) -> str:
    if name not in catalogue:
        raise ValueError(f"unknown sequence {name!r}")
    return name


def category(sequence: str) -> str:
    """A sequence name without its number."""
    return sequence.rstrip("0123456789")


def drive(sequence: str) -> str:
    """A sequence name without its part letter."""
    return re.sub(r"_[^\W\d_]+$", "", sequence)


def dsec_sequence(root: str, sequence: str, split: str = "train") -> dict[str, str]:
    """Folder of each modality: per modality below root, below root/split (or Split), all below root/split/sequence, or root itself the sequence."""
    if split not in ("train", "test"):
        raise ValueError(f"split must be train or test, got {split!r}")
    found = {}
    for kind in ("events", "images", "flow", "disparity", "optical_flow", "calibration"):
        ways = (
            f"{root}/{split}_{kind}/{sequence}/{kind}", f"{root}/{split}_{kind}/{sequence}", f"{root}/{kind}/{sequence}", f"{root}/{split}/{sequence}/{kind}",
            f"{root}/{split.capitalize()}/{sequence}/{kind}", f"{root}/{sequence}/{kind}", f"{root}/{kind}",
        )
        for way in ways:
            if files.exists(way):
                found[kind] = way
                break
    if not found:
        raise FileNotFoundError(f"no data of {sequence} below {root}")
    return found


def auxiliary_root(root: str, sequence: str) -> str:
    """Where a drive's bags and calibrations are: below root, or else one level up."""
    above = root.rstrip("/").rpartition("/")[0]
    own = f"data/{drive(sequence)}"
    return above if not files.exists(f"{root}/{own}") and files.exists(f"{above}/{own}") else root


def yaml_calibration(path: str) -> dict:
    """A calibration file; a leading %YAML directive of an older style is skipped."""
    import yaml

    text = files.read(path).decode()
    return yaml.safe_load(re.sub(r"\A%YAML[^\n]*\n", "", text)) or {}
