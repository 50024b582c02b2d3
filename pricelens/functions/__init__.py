"""Pure ``Column -> Column`` building blocks (JVM-side, codegen-friendly)."""

from pricelens.functions.text import (  # noqa: F401
    battery_from_text, city_of, format_price, listing_id_from_url, normalize_query,
    parse_price, py_strip, storage_of, upgrade_image_url,
)
from pricelens.functions.numeric import py_round  # noqa: F401
