"""Column functions of events and rasters, for use in select and withColumn."""

from ..operators.render import depth_level, hsv_to_rgb
from ..operators.representations import to_byte
from ..operators.select import color, finite, normalize_index
from ..operators.spatial import clip
from ..schema import polarity, seconds

__all__ = ["clip", "color", "depth_level", "finite", "hsv_to_rgb", "normalize_index", "polarity", "seconds", "to_byte"]
