"""Column contracts of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Schemas are DDL text, which the readers accept as it is.
SALES = ("Date DATE, SKU STRING, Quantity BIGINT, Amount DOUBLE, Rate DOUBLE, "
                "Partyname STRING, Godown STRING, Statefrom STRING, Stateto STRING, "
                "Orderid STRING")
RETURNS = SALES
SKU_MASTER = ("sku STRING, category STRING")
MOQ_LEADTIME = ("sku STRING, moq BIGINT, lead_time_days INT, supplier STRING, "
                       "unit_cost DOUBLE")
INVENTORY = ("sku STRING, current_stock BIGINT, reserved_stock BIGINT, "
                    "available_stock BIGINT")
PREDICTIONS = ("SKU STRING, predicted_monthly_quantity BIGINT, "
                      "predicted_daily_average DOUBLE, growth_rate DOUBLE, "
                      "seasonal_multiplier DOUBLE, confidence STRING, product_name STRING")

# Columns an upload must have.
REQUIRED_SALES = ["Date", "SKU", "Quantity", "Amount"]
REQUIRED_SKU_MASTER = ["sku", "category"]

# Raw column names and the names used downstream.
RAW_NAMES = {
    "sku": "SKU",
    "orderid": "OrderID",
    "partyname": "PartyName",
    "asin": "ASIN",
    "stateto": "Stateto",
    "statefrom": "Statefrom",
    "godown": "FulfillmentCenterID",
}

# Fields a prediction request must and may carry.
REQUEST_FIELDS = {
    "daily_prediction": {
        "required": ["sku", "date", "quantity_lag1", "quantity_lag7", "quantity_lag30",
                     "month", "day_of_week"],
        "optional": ["year", "quarter", "seasonal_factor"],
    },
    "monthly_prediction": {
        "required": ["sku", "year", "month", "quantity_lag1", "quantity_lag3",
                     "quantity_lag6", "quantity_lag12", "ma_3", "ma_6", "ma_12",
                     "month_sin", "month_cos", "yoy_growth", "trend"],
        "optional": ["quarter", "rate", "amount"],
    },
    "batch_prediction": {
        "required": ["csv_file_path", "prediction_type"],
        "optional": ["date_range", "sku_filter"],
    },
}

_TEXT_FIELDS = {"sku", "date", "csv_file_path", "prediction_type", "date_range", "sku_filter"}
_WHOLE_FIELDS = {"month", "day_of_week", "year", "quarter", "trend"}


def request_template(prediction_type: str) -> T.StructType:
    """Schema of a prediction request: every required and optional field, all nullable."""
    if prediction_type not in REQUEST_FIELDS:
        raise ValueError(f"Unknown prediction type: {prediction_type}. "
                         f"Available: {list(REQUEST_FIELDS)}")
    fields = REQUEST_FIELDS[prediction_type]
    out = T.StructType()
    for name in fields["required"] + fields["optional"]:
        kind = (T.StringType() if name in _TEXT_FIELDS
                else T.IntegerType() if name in _WHOLE_FIELDS else T.DoubleType())
        out = out.add(name, kind, True)
    return out
