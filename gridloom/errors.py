"""Errors of the engine, one class for each contract that a call can break."""


class CubeError(Exception):
    """Base of all errors of the engine."""


def _error(name: str, text: str) -> type[CubeError]:
    return type(name, (CubeError,), {"__doc__": text, "__module__": __name__})


DimensionLabelCountMismatch = _error("DimensionLabelCountMismatch", "The dimension has more labels than allowed.")
ArrayElementParameterConflict = _error("ArrayElementParameterConflict", "Index and label are both given.")
ArrayElementParameterMissing = _error("ArrayElementParameterMissing", "Neither index nor label is given.")
ArrayNotLabeled = _error("ArrayNotLabeled", "The array has no labels.")
ArrayElementNotAvailable = _error("ArrayElementNotAvailable", "No such element.")
ArrayLabelConflict = _error("ArrayLabelConflict", "Both arrays have a label in common.")
ArrayLengthMismatch = _error("ArrayLengthMismatch", "The numbers of values and labels differ.")
LabelExists = _error("LabelExists", "The label exists.")
TooManyDimensions = _error("TooManyDimensions", "Too many dimensions for this operation.")
ProcessParameterMissing = _error("ProcessParameterMissing", "A parameter is missing.")
ModelNotFoundException = _error("ModelNotFoundException", "No model is given.")
DimensionNotAvailable = _error("DimensionNotAvailable", "No such dimension.")
DimensionExists = _error("DimensionExists", "The dimension exists.")
OverlapResolverMissing = _error("OverlapResolverMissing", "Overlapping cubes need a resolver.")
QuantilesParameterMissing = _error("QuantilesParameterMissing", "Neither probabilities nor q is given.")
QuantilesParameterConflict = _error("QuantilesParameterConflict", "Probabilities and q are both given.")
DimensionMissing = _error("DimensionMissing", "A dimension of the needed type is missing.")
BandFilterParameterMissing = _error("BandFilterParameterMissing", "No bands are given.")
NoDataAvailable = _error("NoDataAvailable", "There is no data for the extent.")
TemporalExtentEmpty = _error("TemporalExtentEmpty", "The extent ends before it starts.")
DimensionAmbiguous = _error("DimensionAmbiguous", "The dimension can't be told.")
NirBandAmbiguous = _error("NirBandAmbiguous", "The near-infrared band can't be told.")
RedBandAmbiguous = _error("RedBandAmbiguous", "The red band can't be told.")
BandExists = _error("BandExists", "A band of this name exists.")
DimensionMismatch = _error("DimensionMismatch", "The dimensions differ.")
LabelMismatch = _error("LabelMismatch", "The numbers of old and new labels differ.")
LabelNotAvailable = _error("LabelNotAvailable", "No such label.")
LabelsNotEnumerated = _error("LabelsNotEnumerated", "The labels aren't enumerated, so the old ones must be named.")
KernelDimensionsUneven = _error("KernelDimensionsUneven", "A kernel needs an odd number of rows and columns.")
MinMaxSwapped = _error("MinMaxSwapped", "The minimum is above the maximum.")
UnitMismatch = _error("UnitMismatch", "The unit of the reference system doesn't fit.")
GeometriesOverlap = _error("GeometriesOverlap", "Geometries overlap.")
FormatUnsuitable = _error("FormatUnsuitable", "The format can't hold this data.")
CrsNotSupported = _error("CrsNotSupported", "The reference system isn't supported.")
