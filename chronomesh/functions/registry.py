"""Operators by name, with their parameters, so that decisions and tools can refer to them as data."""

from __future__ import annotations

import inspect
from collections.abc import Callable

KINDS = ("STATIC", "CONT", "STATE", "PREP", "MEASURE", "SUMMARY")


_own: dict[str, tuple[str, Callable]] = {}


def register(name: str, kind: str) -> Callable[[Callable], Callable]:
    """Decorator: make an own function (DataFrame, **parameters) -> DataFrame known by a name."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    def keep(f: Callable) -> Callable:
        _own[name] = (kind, f)
        return f

    return keep


def operators() -> dict[str, tuple[str, Callable]]:
    """name -> (kind, function)."""
    from chronomesh.operators import dynamic, edges, graph_measures, graph_paths, graph_prep, phase, recursive, states, static, wavelet

    made: dict[str, tuple[str, Callable]] = {}
    for kind, module, names in (
        ("STATIC", static, "pearson covariance partial mutual_information"),
        ("CONT", dynamic, "sliding_window jackknife temporal_derivatives spatial_distance"),
        ("CONT", phase, "phase_synchronisation leida"),
        ("CONT", recursive, "flexible_least_squares dynamic_conditional_correlation"),
        ("CONT", wavelet, "wavelet_coherence"),
        ("CONT", edges, "edge_series"),
        ("STATE", states, "kmeans_cluster sliding_window_clustering coactivation_patterns ksvd_states gaussian_hmm_states discrete_hmm_states"),
        ("SUMMARY", states, "fractional_occupancy dwell_times transition_counts transition_matrix switches"),
        ("PREP", graph_prep, "handle_negative_weights threshold binarise normalise minmax_scale invert log_transform randomise postprocess"),
        ("MEASURE", graph_measures, "degrees density clustering onnela transitivity matching_index participation participation_directed participation_signed two_core"),
        ("MEASURE", graph_paths, "distances average_path efficiency betweenness_centrality eigenvector page_rank backbone_edges communities small_world_sigma small_world_propensity nested_partition"),
    ):
        made |= {n: (kind, getattr(module, n)) for n in names.split()}
    return made | _own


def describe(name: str) -> dict:
    """Kind, parameters with their defaults and annotations, and the first line of the docstring."""
    kind, f = operators()[name]
    parameters = {k: {"default": None if p.default is inspect.Parameter.empty else p.default, "type": str(p.annotation)} for k, p in list(inspect.signature(f).parameters.items())[1:]}
    return {"name": name, "kind": kind, "parameters": parameters, "doc": (inspect.getdoc(f) or "").split("\n")[0]}


def call(spec: dict, *data):
    """Run {"func": name, "args": {..}} on data: only registered operators can be named."""
    found = operators().get(spec["func"])
    if found is None:
        raise ValueError(f"unknown operator {spec['func']}")
    return found[1](*data, **spec.get("args", {}))
