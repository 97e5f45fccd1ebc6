"""Rollgrid: Spark jobs for attendance, bookings and vector identity."""
