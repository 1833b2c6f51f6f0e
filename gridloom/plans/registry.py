"""Processes by name: scalar functions, array functions, reducers, cube operators and loaders."""

from __future__ import annotations

from collections.abc import Callable

from gridloom.cube import Cube
from gridloom.functions import arrays, reducers, scalar

SCALAR = (
    "e pi nan constant add subtract multiply divide floor ceil _int _round exp ln log sin cos tan arcsin arccos arctan sinh cosh tanh arsinh arcosh artanh arctan2"
    " linear_scale_range mod absolute sgn sqrt power clip normalized_difference eq neq gt gte lt lte between is_nan is_nodata is_infinite is_valid _and _or xor _not _if"
    " text_begins text_contains text_ends text_concat date_between date_difference date_shift"
).split()
ARRAY = (
    "array_create array_create_labeled array_modify array_concat array_append array_find array_find_label array_filter array_labels array_apply sort order rearrange"
).split()
REDUCERS = (
    "_min _max _sum product mean median sd variance extrema quantiles count first last _any _all array_element array_contains cumsum cumproduct cummin cummax array_interpolate_linear"
).split()
CUBES = (
    "add_dimension drop_dimension rename_dimension rename_labels dimension_labels trim_cube inspect filter_temporal filter_labels filter_bands filter_bbox filter_spatial"
    " mask mask_polygon merge_cubes reduce_dimension reduce_spatial aggregate_temporal aggregate_temporal_period aggregate_spatial apply apply_dimension apply_polygon apply_kernel"
    " ndvi ddmc resample_spatial resample_cube_spatial resample_cube_temporal fit_curve predict_curve fit_regr_random_forest predict_random_forest run_udf"
).split()


def _loaders() -> dict[str, Callable]:
    from gridloom.sources import cubes, stac, vectors

    return {
        "load_stac": stac.load_stac, "load_url": vectors.load_url, "load_geojson": vectors.load_geojson, "load_vector_cube": vectors.load_vector_cube,
        "create_data_cube": cubes.create_data_cube, "vector_buffer": vectors.vector_buffer, "vector_reproject": vectors.vector_reproject,
    }


def processes() -> dict[str, Callable]:
    """All processes; names that Python reserves go without their underscore."""
    out: dict[str, Callable] = {}
    for module, names in ((scalar, SCALAR), (arrays, ARRAY), (reducers, REDUCERS)):
        out.update({n.lstrip("_"): getattr(module, n) for n in names})
    out.update({n: getattr(Cube, n) for n in CUBES})
    out["rqadeforestation"] = Cube.rqa_trend
    out["apply_neighborhood_intertwin"] = Cube.apply_neighborhood
    return {**out, **_loaders()}
