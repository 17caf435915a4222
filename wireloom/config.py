"""Settings of a run, with the values that a run uses unless told otherwise."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    # Thresholds and sizes in pixels unless named otherwise.
    domain: str = "auto"
    binarize_block: int = 31
    binarize_offset: float = 7.0
    denoise: bool = True
    speckle_area: int = 2
    deskew_most_degrees: float = 5.0
    color_layers: bool = True
    thin_width: int = 4
    density_window: int = 25
    density_least: int = 3
    density_merge: int = 9
    box_pad: int = 4
    box_least_area: int = 80
    box_most_area: int = 40000
    merge_overlap: float = 0.5
    use_detector: bool = True
    use_second_detector: bool = False
    detector_confidence: float = 0.12
    detector_overlap: float = 0.45
    model: str = "dinov2_vitb14"
    embedding_size: int = 768
    turns: tuple = (0, 90, 180, 270)
    mirror: bool = True
    similarity_floor: float = 0.62
    ambiguity_margin: float = 0.15
    reading_scale: int = 3
    reading_turns: tuple = (0, 90, 270)
    reading_modes: tuple = ("--psm 11", "--psm 12", "--psm 6 -c load_system_dawg=0 -c load_freq_dawg=0")
    token_distance: int = 45
    dot_least_radius: int = 2
    dot_radius: int = 5
    dot_fill: float = 0.6
    snap_radius: int = 12
    snap_reach: int = 25
    snap_cone_degrees: float = 70.0
    prune_length: int = 3
    least_confidence: float = 0.5
    outputs: str = "outputs"
    version: str = "0.1.0"

    def __post_init__(self):
        for f in fields(self):
            value, kind = getattr(self, f.name), f.type
            good = {"str": isinstance(value, str), "bool": isinstance(value, bool), "tuple": isinstance(value, tuple)}
            if not good.get(kind, isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "float" or value == int(value))):
                raise TypeError(f"{f.name} can't be {value!r}")

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """The settings of a YAML or JSON file: by these names, or in blocks (BLOCKS); missing ones have their usual values.

        Unknown names raise an error, unknown entries of a block are passed over.
        """
        if path is None:
            return cls()
        from wireloom.sources.domains import read

        given = {}
        for name, value in read(Path(path)).items():
            if name in BLOCKS and isinstance(value, dict):
                given |= {BLOCKS[name][k]: v for k, v in value.items() if k in BLOCKS[name]}
            elif name not in BLOCKS or value is not None:
                given[name] = value
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


#: Entries of a file's blocks and the settings they are.
BLOCKS = {
    "preprocess": {
        "binarize_block_size": "binarize_block", "binarize_c": "binarize_offset", "denoise": "denoise", "denoise_min_speckle_area": "speckle_area",
        "deskew_max_angle_deg": "deskew_most_degrees", "color_layer_split": "color_layers",
    },
    "localize": {
        "min_component_area": "box_least_area", "max_component_area": "box_most_area", "thin_stroke_max_width": "thin_width", "density_window": "density_window",
        "density_threshold": "density_least", "density_merge_kernel": "density_merge", "candidate_bbox_pad": "box_pad", "candidate_merge_overlap": "merge_overlap",
        "use_yolo": "use_detector", "use_real_detector": "use_second_detector", "yolo_conf_threshold": "detector_confidence", "yolo_iou_threshold": "detector_overlap",
    },
    "classify": {
        "model": "model", "embedding_dim": "embedding_size", "rotations": "turns", "mirror": "mirror", "unknown_similarity_threshold": "similarity_floor",
        "ambiguity_margin_threshold": "ambiguity_margin",
    },
    "text": {"upscale_factor": "reading_scale", "orientations": "reading_turns", "max_association_distance": "token_distance", "tesseract_configs": "reading_modes"},
    "wires": {
        "junction_dot_min_radius": "dot_least_radius", "junction_dot_max_radius": "dot_radius", "junction_dot_fill_ratio": "dot_fill", "terminal_snap_radius": "snap_radius",
        "terminal_directional_reach": "snap_reach", "terminal_snap_cone_deg": "snap_cone_degrees", "skeleton_prune_min_length": "prune_length",
    },
    "validation": {"min_confidence": "least_confidence"},
    "output": {"outputs_dir": "outputs", "pipeline_version": "version"},
}
