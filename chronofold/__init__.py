"""Spark-native engine for time-series features and for cleaning the records they come from."""

from importlib import import_module

_PLACES = {
    "functions.settings": ("ComprehensiveFCParameters", "EfficientFCParameters", "IndexBasedFCParameters", "MinimalFCParameters", "TimeBasedFCParameters", "from_columns"),
    "operators.impute": ("get_ids", "get_range_values_per_column", "impute", "impute_dataframe_range", "impute_dataframe_zero", "restrict_input_to_index"),
    "operators.relevance": ("calculate_relevance_table", "select_features"),
    "operators.rolling": ("add_sub_time_series_index", "make_forecasting_frame", "roll_time_series", "rolling_features"),
    "plans.extract": ("extract_features",),
    "plans.pipeline": ("FeatureAugmenter", "FeatureSelector", "PerColumnImputer", "RelevantFeatureAugmenter", "extract_relevant_features"),
}
_PLACE_OF = {name: place for place, names in _PLACES.items() for name in names}
__all__ = sorted(_PLACE_OF)


def __getattr__(name: str):
    """Names are imported when they are used: Python workers load only the module they run."""
    if name in _PLACE_OF:
        return getattr(import_module(f"{__name__}.{_PLACE_OF[name]}"), name)
    raise AttributeError(name)
