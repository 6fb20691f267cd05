"""Report operators: monthly cube, period report, entry points, org and carbon views."""
