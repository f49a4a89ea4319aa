"""Exception classes of the engine."""


class GeoError(Exception):
    """Base of all."""


class NotFoundError(GeoError):
    pass


class ComputeError(GeoError):
    pass


class NoDataError(GeoError):
    pass


class ShapeError(GeoError):
    pass


class SchemaError(GeoError, ValueError):
    pass


class DuplicateError(GeoError):
    pass


class InvalidOperationError(GeoError, ValueError):
    pass


class GeometryTypeError(InvalidOperationError, TypeError):
    pass


class CrsError(GeoError, ValueError):
    pass
