"""Building-plan geometry on Spark: walls, openings, rooms, stairs, text, calibration and plan documents."""
