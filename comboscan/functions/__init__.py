"""Part of comboscan."""
