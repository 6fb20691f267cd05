"""Named, registered queries over the driver tables, their SQL oracles and plan checks."""
