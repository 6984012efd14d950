"""Water temperature, gas exchange and dissolved gas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segflux.functions import hydraulics, nulls

# --- fixed values -----------------------------------------------------------------------
LOW_SLOPE = 0.01
LOW_DISSIPATION = 0.02  # m2/s3
REFERENCE_SCHMIDT = 600.0
AMBIENT_PCO2 = 380.0  # uatm
FLUX_FACTOR = 4.38  # mmol C/m3 x m/d to g C/m2/yr: 365 * 12 / 1000
# ----------------------------------------------------------------------------------------


def water_temperature(air_temperature: Column) -> Column:
    """Water temperature from air temperature, never below freezing."""
    return nulls.at_least(0.67 * air_temperature + 7.45, F.lit(0.0))


def schmidt_number(t: Column) -> Column:
    return 1742.0 - 91.24 * t + 2.208 * t * t - 0.0219 * t * t * t


def k600_low_energy(slope: Column, velocity: Column) -> Column:
    """Linear relation used on gentle slopes and at low dissipation."""
    return 2841.0 * slope * velocity + 2.02


def k600_high_energy(dissipation: Column) -> Column:
    """Power relation used on steep, turbulent reaches."""
    return F.exp(1.18 * nulls.log_positive(dissipation) + 6.43)


def gas_transfer_velocity(slope: Column, velocity: Column, schmidt: Column) -> Column:
    """Gas transfer velocity in m/d at the given Schmidt number."""
    dissipation = hydraulics.energy_dissipation(slope, velocity)
    gentle = (slope <= LOW_SLOPE) | (dissipation <= LOW_DISSIPATION)
    k600 = F.when(gentle, k600_low_energy(slope, velocity)).when(
        dissipation > LOW_DISSIPATION, k600_high_energy(dissipation)
    )
    return k600 * F.sqrt(F.when(schmidt > 0, REFERENCE_SCHMIDT / schmidt))


def excess_co2(pco2: Column, t: Column) -> Column:
    """Dissolved gas above equilibrium with air, from partial pressure and temperature."""
    solubility = -0.00007 * t * t + 0.016 * t + 1.11
    return (pco2 - AMBIENT_PCO2) * F.pow(F.lit(10.0), -solubility)


def areal_flux(co2: Column, k: Column) -> Column:
    """g C per m2 and year."""
    return co2 * k * FLUX_FACTOR


def emission(co2: Column, k: Column, area_km2: Column) -> Column:
    """Gg C per year from an area in km2."""
    return areal_flux(co2, k) * area_km2 / 1000.0
