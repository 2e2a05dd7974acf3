"""Column -> Column building blocks. Nothing here touches a DataFrame or the driver."""
