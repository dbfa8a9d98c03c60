"""Small word pools behind the name, place, company and text families.

The generated names are inventions of these lists; nothing else depends on them.
"""

from __future__ import annotations

import unicodedata

FIRST_NAMES = (
    "Ana María José Luis Carlos Elena Sofía Miguel Lucía Jorge Carmen Pedro Rosa Juan Laura Andrés "
    "Isabel Raúl Teresa Hugo Paula Iván Marta Óscar Julia Diego Clara Rubén Nuria Tomás Adela Bruno "
    "Irene Fabián Gloria Emilio Daniela Saúl Silvia Víctor"
).split()
LAST_NAMES = (
    "García Hernández Martínez López González Pérez Rodríguez Sánchez Ramírez Cruz Flores Gómez Morales "
    "Vázquez Jiménez Reyes Díaz Torres Gutiérrez Ruiz Mendoza Aguilar Ortiz Castillo Chávez Ramos Juárez "
    "Herrera Medina Castro Vargas Guzmán Velázquez Muñoz Rojas Salazar Ortega Delgado Rivera Soto"
).split()
CITIES = [
    "Guadalajara", "Monterrey", "Puebla", "Tijuana", "León", "Mérida", "Querétaro", "Toluca", "Cancún", "Saltillo",
    "Hermosillo", "Morelia", "Veracruz", "Culiacán", "Chihuahua", "Oaxaca", "Tampico", "Durango", "Colima", "Xalapa",
]
STATES = [
    "Jalisco", "Nuevo León", "Puebla", "Baja California", "Guanajuato", "Yucatán", "Querétaro", "México",
    "Quintana Roo", "Coahuila", "Sonora", "Michoacán", "Veracruz", "Sinaloa", "Chihuahua", "Oaxaca",
]
COUNTRIES = [
    "México", "España", "Argentina", "Colombia", "Chile", "Perú", "Uruguay", "Ecuador", "Bolivia", "Panamá",
    "Cuba", "Guatemala", "Honduras", "Brasil", "Canadá", "Francia", "Italia", "Japón", "Alemania", "Portugal",
]
STREET_KINDS = ["Calle", "Avenida", "Calzada", "Privada", "Callejón", "Boulevard"]
CITY_SUFFIXES = ["Centro", "Norte", "Sur", "Oriente", "Poniente", "Del Valle", "Las Lomas", "San Pedro"]
COMPANY_SUFFIXES = ["S.A. de C.V.", "e Hijos", "y Asociados", "Grupo", "S.C.", "Industrias"]
JOBS = [
    "Contador", "Ingeniera civil", "Médico general", "Abogada", "Arquitecto", "Diseñadora", "Electricista",
    "Enfermero", "Economista", "Profesora", "Programador", "Química", "Chofer", "Cocinera", "Gerente", "Analista",
]
MAIL_DOMAINS = ["example.com", "example.org", "example.net", "correo.example", "mail.example"]
TOP_LEVELS = ["com", "org", "net", "mx", "info"]
AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/128.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/126.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) AppleWebKit/605.1.15 Version/17.5 Safari/605.1.15",
    "Mozilla/5.0 (Linux; Android 14) AppleWebKit/537.36 Chrome/126.0 Mobile Safari/537.36",
]
COLOURS = ["Rojo", "Verde", "Azul", "Negro", "Blanco", "Amarillo", "Naranja", "Violeta", "Gris", "Turquesa"]
LANGUAGES = ["Español", "Inglés", "Francés", "Alemán", "Italiano", "Portugués", "Náhuatl", "Maya", "Japonés", "Árabe"]
# Sixty-four words: six bits of a draw choose one.
WORDS = (
    "casa tiempo agua mesa libro noche campo puerta viento ciudad camino fuego luz sombra piedra nube barco "
    "mercado jardín escuela ventana papel reloj montaña playa bosque puente torre plaza río sueño verano invierno "
    "lluvia tierra cielo estrella espejo silla cocina taller oficina proyecto idea cuenta número letra voz canción "
    "pintura historia viaje tren carta moneda semilla árbol flor fruta pan sal azúcar miel café"
).split()


def ascii_lower(text: str) -> str:
    folded = unicodedata.normalize("NFKD", text)
    return "".join(c for c in folded if not unicodedata.combining(c)).lower()


MAIL_FIRST = [ascii_lower(n) for n in FIRST_NAMES]
MAIL_LAST = [ascii_lower(n) for n in LAST_NAMES]
