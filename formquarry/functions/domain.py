"""Fixed values of the domain, stated as they are."""

# Element types that can be bound to data.
DATA_ELEMENT_TYPES = ("Field", "InputField", "Table", "CheckBox", "Calendar", "Chart", "Picture")
# Element types that never are.
SERVICE_ELEMENT_TYPES = ("Label", "CommandPanel", "Panel", "Page", "Group", "Button", "Separator", "Unknown")
# Attributes the platform adds to objects.
PLATFORM_STANDARD_ATTRIBUTES = ("Код", "Наименование", "Родитель", "Дата", "Номер", "ПометкаУдаления")

# Beginnings of lower-case form names that mean a service form.
SERVICE_NAME_PREFIXES = (
    "помощник", "мастер", "диалог", "добавление", "управление", "регистрация", "программа", "подбор",
    "подсказка", "предопределен", "включение", "обновление", "конвертация", "реклама", "нерекомендуем", "вопрос",
)
# Lower-case names of the platform's own object forms.
PLATFORM_FORM_NAMES = (
    "форма", "формаобъекта", "формаэлемента", "формадокумента", "формагруппы", "формасписка", "формавыбора", "формавыборагруппы",
    "формазаписи", "формаконстант", "формаотчета", "формаотчёта", "формаостатков", "формадвижений", "формарегистра", "формажурнала", "формануля",
)
# Beginnings that only hint at a service form.
SERVICE_NAME_HINTS = (
    "форма", "редактирование", "передача", "выбор", "настройка", "запрос", "ввод", "просмотр", "печать", "загрузка",
    "выгрузка", "сохранение", "проверка", "установка", "подключение", "категории", "значения", "изменение", "ход",
)
# Fixed value: the beginning of a lower-case data path that binds to the form's object.
OBJECT_BINDING_PREFIX = "объект."

# Object types that have references, with the name of the reference type.
REFERENCE_TYPE_PREFIXES = {
    "Catalog": "CatalogRef",
    "Document": "DocumentRef",
    "Enum": "EnumRef",
    "ChartOfCharacteristicType": "ChartOfCharacteristicTypeRef",
    "ExchangePlan": "ExchangePlanRef",
    "BusinessProcess": "BusinessProcessRef",
    "Task": "TaskRef",
}
# One-letter codes of primitive types.
PRIMITIVE_TYPES = {"S": "String", "N": "Number", "B": "Boolean", "D": "Date", "U": "Undefined", "T": "Null"}
REFERENCE_MARK = "Ref#"

# Keys of element files, by meaning, in order of preference.
TYPE_KEYS = ("type", "Тип", "item_type", "kind", "Вид")
NAME_KEYS = ("name", "Имя", "caption", "Заголовок", "identifier", "Идентификатор")
PAGE_KEYS = ("page", "Страница", "page_id", "Page")
HANDLER_KEYS = ("handler", "Обработчик", "event_handler", "Action", "Действие")
DATA_PATH_KEYS = ("data_path", "ПутьКДанным", "dataPath", "binding", "Привязка")
RAW_DATA_PATH_KEYS = ("DataPath", "data_path", "ПутьКДанным", "dataPath", "binding", "Привязка")
PARENT_KEYS = ("parent", "Parent", "Родитель", "parent_name", "parentName")
ATTRIBUTE_CHILD_KEYS = ("child", "Child", "children", "Children", "items", "Items")
PAGES_KEY = "-pages-"
OBJECT_PREFIX, LIST_PREFIX = "Объект", "Список"
# Suffixes of a procedure that handles an element's event, in order of preference.
HANDLER_SUFFIXES = ("Нажатие", "ПриИзменении", "ПриАктивизации", "Выбор")
# Sources of one element in order of preference.
SOURCE_ORDER = ("data", "props", "tree", "commands", "params")

# Identifiers of widgets in positional forms.
TABULAR_FIELD = "ea83fe3a-ac3c-4cce-8045-3dddf35b28b1"
WIDGET_TYPES = {"381ed624-9217-4e63-85db-c4c3cb87daae": "InputField", "64483e7f-3833-48e2-8c75-2c31aac49f6e": "ComboBox"}
# Identifiers that belong to the platform itself.
PLATFORM_UUIDS = (
    "e1692cc2-605b-4535-84dd-28440238746c", "35af3d93-d7c7-4a2e-a8eb-bac87a1a3f26", "d2314b5d-8da4-4e0f-822b-45e7500eae09",
    "48a6ebc3-fcc8-4f8f-b399-459fb32aa46b", "99f52caa-7b96-4bd4-a649-aedbd230a555", "e603c0f2-19d7-4f5d-9374-e61a0ee5c5a6",
    "737535a4-4743-4d3e-98f7-0b40d6ab0c02", "acf6192e-8d63-4a2f-977a-3d88d786b0ac", "4652c4ec-6a7a-43ab-9a7e-7c39ea42e870",
    "381ed624-9217-4e63-85db-c4c3cb87daae", "ea83fe3a-ac3c-4cce-8045-3dddf35b28b1",
)
# Sources of tabular fields that the platform fills at run time.
PLATFORM_SOURCES = (
    "Отбор", "ПостроительОтбор", "ИзмеренияСтроки", "ИзмеренияКолонки", "Порядок", "ПоляДляПорядка", "ПоляДляВыбранных",
    "ВыбранныеПоля", "ПоказателиДиаграммы", "СерииИТочкиДиаграммы", "ТабличноеПолеДеревоПоказателей", "ТабличноеПолеПараметров",
)
# Positions of standard attributes in the identity block, and the owners that have them.
STANDARD_SLOTS = {7: "Наименование", 8: "Код"}
STANDARD_OWNERS = ("Catalog", "ChartOfCharacteristicType")
# Fixed value: where an element's record holds its binding.
BIND_SLOT = 11
