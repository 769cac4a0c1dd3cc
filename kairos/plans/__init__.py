"""Query plans over the driver's tables (stand-ins for the study data)."""
