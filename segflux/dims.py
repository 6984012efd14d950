"""Fixed dimensions: months, climate bands, rating coefficients, labels.

Everything here has a size known in advance, so it is safe to broadcast or inline.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
ANNUAL = "Ann"
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# Runoff classes in mm/yr: upper bound (exclusive), class, and width rating ln W = a + b ln Q.
RUNOFF_CLASSES = (
    (50.0, "ARID", 2.1, 0.43),
    (200.0, "MOD1", 2.1, 0.47),
    (500.0, "MOD2", 2.24, 0.47),
    (1000.0, "WET1", 2.2, 0.45),
    (None, "WET2", 1.92, 0.49),
)
WETNESS_CLASSES = ((50.0, "Arid"), (500.0, "Mod"), (None, "Wet"))

# Climate bands from north to south; the long labels name basins, the short ones sites.
BAND_EDGES = (56.0, 23.5, -23.5)
BANDS_LONG = ("Polar", "North Temperate", "Tropical", "South Temperate")
BANDS_SHORT = ("Polar", "N Temperate", "Tropical", "S Temperate")

# Alternative dry-out by stream order: (prec, temp, constant) of the intermittent share and
# of the dry share of time.  Orders above 4 never dry out.
DRYOUT_BY_ORDER = {
    1: ((-0.009, 0.029, 0.77), (-0.0019, 0.017, 0.026)),
    2: ((-0.009, 0.029, 0.61), (-0.0021, 0.011, 0.088)),
    3: ((-0.008, 0.028, 0.44), (-0.0018, 0.011, 0.058)),
    4: ((-0.005, 0.023, 0.27), (-0.0028, 0.012, 0.127)),
}

# Calibration of the seasonal cycle in the southern temperate band, January to December.
SOUTH_CALIBRATION = (1.04, 1.14, 1.11, 1.05, 0.98, 0.97, 0.94, 0.94, 0.96, 0.98, 1.01, 1.02)

# Keys treated specially on the published network.
UPAREA_PATCHES = {61000003: 35.0, 31000001: 35.0}
EXCLUDED_WORKING_BASINS = ("NARID15",)
EXCLUDED_BASINS = ("1040040050", "2040059370", "5040055420")
HIGHLAND_BASINS = (
    "4040838850", "4040050470", "4040050610", "4040050780",
    "4040050810", "4040050910", "4040050980", "4040051270",
)

# Predictors of the concentration models.
FOREST_PREDICTORS = (
    "tavg_00", "prec_00", "gpp_00", "npp_00", "sr_00", "area", "slop", "elev",
    "wetland", "popdens", "sgravel", "ssand", "soc", "sph", "sbs",
)
STEPWISE_ROUNDS = (
    ("tavg_00", "prec_00", "gpp_00", "npp_00", "sr_00", "slop", "elev", "wetland", "popdens", "sph", "sbs"),
    ("tavg_00", "prec_00", "sr_00", "slop", "elev", "wetland", "popdens", "sph", "sbs"),
    ("tavg_00", "prec_00", "sr_00", "slop", "elev", "wetland", "popdens", "sph"),
    ("prec_00", "sr_00", "slop", "elev", "wetland", "popdens", "sph"),
)
LOGGED_COLUMNS = ("area", "elev", "slop", "soc", "scec", "steb", "scaco3", "scaso4", "popdens")

# Predictor levels in display order.
PREDICTOR_LABELS = {
    "lnco2": "Ln CO2",
    "tavg_00": "Temperature (°C)",
    "prec_00": "Precipitation (mm/yr)",
    "gpp_00": "GPP",
    "npp_00": "NPP",
    "sr_00": "Soil resp.",
    "ar_ann": "Autotrophic soil resp.",
    "hr_ann": "Heterotrophic soil resp.",
    "area": "Ln Watershed area (km2)",
    "slop": "Ln Slope (unitless)",
    "elev": "Ln Elevation (m)",
    "wetland": "Wetland (%)",
    "popdens": "Ln pop. dens. (people/km2)",
    "sgravel": "Soil gravel (%v)",
    "ssand": "Soil sand (%w)",
    "ssilt": "Soil silt (%w)",
    "sclay": "Soil clay (%w)",
    "sdensity": "Soil density (kg/m3)",
    "soc": "Ln SOC (%w)",
    "sph": "Soil pH",
    "scec": "Ln Soil CEC (cmol/kg)",
    "sbs": "Base saturation (%)",
    "steb": "Ln Exch. bases (cmol/kg)",
    "scaco3": "Ln Calcium carbonate (%w)",
    "scaso4": "Ln Soil gypsum (%w)",
    "ssodicity": "Soil sodicity (%)",
    "sconductivity": "Soil conductivity (dS/m)",
}

# Values outside these limits are outliers of the named predictor.
OUTLIER_LIMITS = {
    "sph": (3.7, None),
    "sdensity": (1.0, None),
    "ssodicity": (None, 5.0),
    "sconductivity": (None, 0.3),
}
# ----------------------------------------------------------------------------------------


def literal_map(pairs: Mapping) -> Column:
    """A small fixed mapping as one literal map column (lookups stay inside codegen)."""
    items = [F.lit(v) for kv in pairs.items() for v in kv]
    return F.create_map(*items)


def month_number(mon: Column) -> Column:
    """Month label to 1..12; anything else becomes NULL."""
    return F.try_element_at(literal_map({m: i + 1 for i, m in enumerate(MONTHS)}), mon)


def month_label(month: Column) -> Column:
    """Month number 1..12 to its label; anything else becomes NULL."""
    return F.try_element_at(literal_map({i + 1: m for i, m in enumerate(MONTHS)}), month)


def level_dim(
    spark: SparkSession, levels: Sequence[str], labels: Sequence[str] | None = None
) -> DataFrame:
    """Ordered category: code, display label and rank."""
    shown = levels if labels is None else labels
    rows = [(code, label, i + 1) for i, (code, label) in enumerate(zip(levels, shown, strict=True))]
    return spark.createDataFrame(rows, "code string, label string, ord int")
