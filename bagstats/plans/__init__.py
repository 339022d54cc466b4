"""End-to-end jobs: manifest to splits, predictions to reports, patches to a store."""
