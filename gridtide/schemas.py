"""Explicit schemas of the stored market tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "STRING_MAP": T.MapType(T.StringType(), T.StringType()),
}


def schema(columns: str) -> T.StructType:
    """Schema of "name TYPE, name TYPE" without needing a running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RTM_HIST = schema(
    "delivery_date DATE, delivery_hour INT, delivery_interval INT, repeated_hour INT,"
    " settlement_point STRING, settlement_point_type STRING, lmp DOUBLE"
)
DAM_HIST = schema("delivery_date DATE, hour_ending INT, repeated_hour INT, settlement_point STRING, lmp DOUBLE")
ANCILLARY_HIST = schema(
    "delivery_date DATE, hour_ending INT, repeated_hour INT, regdn DOUBLE, regup DOUBLE, rrs DOUBLE, nspin DOUBLE, ecrs DOUBLE"
)
RTM_API = schema(
    "time TIMESTAMP, settlement_point STRING, lmp DOUBLE, energy_component DOUBLE, congestion_component DOUBLE, loss_component DOUBLE"
)
RTM_FEED = schema("time TIMESTAMP, settlement_point STRING, lmp DOUBLE")
FUEL_MIX = schema("delivery_date DATE, fuel STRING, settlement_type STRING, interval_15min INT, generation_mw DOUBLE")
RESERVES = schema(
    "sced_timestamp TIMESTAMP, repeated_hour STRING, batch_id INT, system_lambda DOUBLE, prc DOUBLE, rtolcap DOUBLE,"
    " rtoffcap DOUBLE, rtorpa DOUBLE, rtoffpa DOUBLE, rtolhsl DOUBLE, rtbp DOUBLE, rtordpa DOUBLE"
)
WEATHER = schema(
    "station STRING, time TIMESTAMP, temperature_2m DOUBLE, wind_speed_10m DOUBLE, wind_direction_10m DOUBLE,"
    " relative_humidity_2m DOUBLE, surface_pressure DOUBLE, dew_point_2m DOUBLE"
)
WIND_FORECAST = schema(
    "delivery_date DATE, hour_ending INT, region STRING, gen_mw DOUBLE, stwpf_mw DOUBLE, wgrpp_mw DOUBLE, cop_hsl_mw DOUBLE"
)
SPIKE_LABELS = schema(
    "time TIMESTAMP, settlement_point STRING, lmp DOUBLE, hub_lmp DOUBLE, spread DOUBLE, spike_event BOOLEAN,"
    " lead_spike_60 BOOLEAN, regime STRING"
)
PREDICTIONS = schema(
    "model STRING, settlement_point STRING, target_time STRING, horizon STRING, predicted_value DOUBLE, unit STRING,"
    " metadata STRING_MAP, generated_at STRING"
)
ACTUALS = schema("market STRING, settlement_point STRING, target_time STRING, actual_value DOUBLE")
DAILY_PNL = schema(
    "date DATE, settlement_point STRING, projected_revenue DOUBLE, actual_revenue DOUBLE, charge_cost DOUBLE,"
    " discharge_revenue DOUBLE, cycles DOUBLE, degradation_cost DOUBLE, net_pnl DOUBLE"
)
PRICE_CSV = schema("date STRING, hour INT, interval INT, price DOUBLE, point STRING")
