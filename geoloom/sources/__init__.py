"""Reading vector files, Arrow and pandas exchange, bundled datasets."""

from .arrow import from_arrow, from_data, from_geopandas, from_pandas, from_xy, map_geopandas, to_arrow, to_geopandas, write_arrow
from .files import read_file, write_geojson

__all__ = ["from_arrow", "from_data", "from_geopandas", "from_pandas", "from_xy", "map_geopandas", "read_file", "to_arrow", "to_geopandas", "write_arrow", "write_geojson"]
