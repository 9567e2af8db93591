"""Election analytics on Spark: plain DataFrame plans over a geography, election,
participant and result snowflake."""
